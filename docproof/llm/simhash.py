"""SimHash near-duplicates, found with BK-trees.

A text is lower-cased in A-Z and cut into words at ASCII white space; a bit of its 64-bit fingerprint is set if it is
set in over half the XXH64 values (seed 42) of its three-word shingles. Fingerprints link when at most ``radius`` bits
differ, documents are grouped by the components of these links.

Equal fingerprints are one from here on. The 64 bits are cut into blocks so that two linked fingerprints agree in all
but ``radius`` of them; for each choice of the blocks that may differ the others are a shard key, so every link falls
into some shard. Each shard builds a BK-tree (children keyed by their distance to the parent) and follows only edges
within the radius of a query's distance. The number of blocks follows the number of fingerprints and keeps shards
small; a shard that is still large is cut into pieces, and each pair of pieces is a task of its own with one tree, sent
to the tasks that query it. Trees are bounded (``TREE_NODES``); nothing that grows with the data is broadcast by hand.
A task gives a spanning forest of its links, never all pairs.

Edge cases: a text that is null or has no word has fingerprint zero, linked like any other; fewer than three words are
one shingle; a null doc_id gets its group but names none (component_id is null if the group has no other id); repeated
rows are equal fingerprints; long texts are counted in bounded steps; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import Forest, components, contracted, group_starts, map_groups, map_text, staged

RADIUS = 3
SHINGLE = 3
SEED = 42
TREE_NODES = 4096
SHARD_MEAN = 1024
STEP = 1 << 16


def shingle_hashes(text: str, words_in_shingle: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    if len(words) <= words_in_shingle:
        return [xxh64_intdigest(joined, SEED)]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words_in_shingle - 1 :])]


def fingerprints(texts: list[str], words_in_shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of texts."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        for at in range(0, len(held), STEP):
            hashes = np.array(held[at : at + STEP], np.uint64)
            who = np.array(owners[at : at + STEP])
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[who[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, words_in_shingle)
        totals[i] = len(hashes)
        held += hashes
        owners += [i] * len(hashes)
        if len(held) >= STEP:
            flush()
    flush()
    set_bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, run, f"doc_id {rows.dtypes[0][1]}, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(distance, new)
            if below == new:
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values that differ in at most ``radius`` bits."""
        if not self.values:
            return []
        values, children, found, open_nodes = self.values, self.children, [], [0]
        while open_nodes:
            at = open_nodes.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            open_nodes += [c for edge, c in children[at].items() if -radius <= edge - distance <= radius]
        return found


def _group_links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one shard: among ``members`` if there are no queries, else between the two."""
    tree = BKTree()
    forest = Forest(len(members) + len(queries))
    if queries:
        for value in members:
            tree.add(value)
    out = []
    both = members + queries
    for i, value in enumerate(queries or members):
        at = i + len(members) if queries else i
        for j in tree.within(value, radius):
            if forest.find(at) != forest.find(j):
                forest.join(at, j)
                out.append((value, both[j]))
        if not queries:
            tree.add(value)
    return out


def shard_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """One key for each choice of ``radius`` blocks that may differ: the choice and the bits of the others."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, open_blocks in enumerate(combinations(range(blocks), radius)):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in range(blocks) if b not in open_blocks)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def block_count(n: int, radius: int = RADIUS) -> int:
    """Blocks that keep the mean shard of evenly spread fingerprints below SHARD_MEAN."""
    blocks = radius + 1
    while n > SHARD_MEAN << (64 * (blocks - radius) // blocks) and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between the distinct longs ``fp``, enough to hold every component together."""
    blocks = blocks or block_count(prints.count(), radius)
    keyed = prints.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["choice", "bits"])
    pieces = F.ceil(F.col("n") / nodes).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    dealt = shared.select("choice", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other"))
    dealt = dealt.select("choice", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                         (F.col("own") > F.col("other")).alias("asks"), "fp")
    keys = ["choice", "bits", "a", "b"]

    def run(rows: pa.Table) -> pa.Table | None:
        starts = group_starts(rows, keys)
        ends = np.append(starts[1:], rows.num_rows)
        values = rows.column("fp").to_numpy().view(np.uint64).tolist()
        asks = rows.column("asks").to_pylist()
        same = (rows.column("a").to_numpy() == rows.column("b").to_numpy()).tolist()
        found = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s < 2:
                continue
            members = [v for v, q in zip(values[s:e], asks[s:e]) if not q]
            queries = [v for v, q in zip(values[s:e], asks[s:e]) if q]
            if same[s] or queries:
                found += _group_links(members, queries, radius)
        if not found:
            return None
        pairs = np.array(found, np.uint64).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return map_groups(dealt, keys, run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the signed fingerprint and the smallest doc_id reachable by links."""
    rows = staged(fingerprint_table(docs, doc_id, text))
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(contracted(links(prints, radius))).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def row_hash(doc_id: Column, text: Column) -> Column:
    """Tells the rows of an id apart by their texts."""
    return F.xxhash64(doc_id, text)


def chosen_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id and ``row_hash`` are in ``chosen`` (id, row, n), once each, and those without an id."""
    kept = staged(chosen.select(F.col("id").alias("__kept"), F.col("row").alias("__row"), (F.col("n") > 1).alias("__twice")))
    own = [docs[c] for c in docs.columns]
    nameless = docs.filter(docs[doc_id].isNull())
    same = (docs[doc_id] == kept["__kept"]) & (row_hash(docs[doc_id], docs[text]) == kept["__row"])
    # Ids grow with the documents: the same join at every size, never a broadcast.
    if kept.filter("__twice").isEmpty():
        return docs.join(kept.hint("merge"), same, "left_semi").unionByName(nameless)
    found = docs.join(kept.hint("merge"), same)
    once = found.filter("NOT __twice").select(*own)
    again = found.filter("__twice").dropDuplicates([doc_id, "__row"]).select(*docs.columns)
    return once.unionByName(again).unionByName(nameless)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with its smallest id, one even if that id is repeated.

    An id that comes with unlike texts may stand for several groups. Rows without an id cannot be named and stay.
    """
    named = F.struct(F.col(doc_id).alias("id"), row_hash(F.col(doc_id), F.col(text)).alias("row"))
    rows = docs.select(F.when(F.col(doc_id).isNotNull(), named).alias("name"), F.col(text).alias("text"))
    least = near_duplicates(rows, "name", "text", radius).filter("doc_id = component_id")
    chosen = least.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id.id", "doc_id.row", "n")
    return chosen_rows(docs, chosen, doc_id, text)
