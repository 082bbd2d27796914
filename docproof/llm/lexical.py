"""Ranked lexical search with norm buckets.

A document is a vector of impacts: for each term its weight times its damped count, in whole numbers. An item is a
vector of term counts, and a score is their inner product. Only coordinates that some item of the block has are kept,
so the lengths are those of what can score at all. All vectors are ordered by length and cut into buckets. For an item
and the score its k-th best hit has so far,

* a bucket is passed over if the item's length times the greatest length in it cannot reach that score,
* inside, coordinates come in the order of what they can add at most in this bucket. Those at the end that cannot reach
  the score even together start no candidate; the vectors that hold one of the others get a bound from the coordinates
  seen, and from the lengths and maxima of those left,
* vectors whose bound reaches the score are scored in whole numbers from all their coordinates.

The buckets at the head of each range of lengths are searched first; their k-th best scores are true lower limits and
go along with the search of all others. Limits are compared with a margin for rounding, and equal scores always pass,
so results are exact.

Items are read in blocks of ``BLOCK_ITEMS`` items or ``BLOCK_BYTES`` of text (an item at least), each a search over all
documents: what the tasks are sent is bounded. The words of a document are counted once a block.

Edge cases: null and wordless texts have no terms, are found by nobody and count in no statistic; documents without an
id count in the statistics but cannot be named as hits; repeated documents each count and may each be a hit; of rows
with one item id the smallest text asks, items without an id or a term ask nothing; fewer than k scoring documents are
all returned; empty tables give an empty result. Scores must fit a long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import map_text, staged

BLOCK_ITEMS = 2048
BLOCK_BYTES = 8 << 20
BUCKET_ROWS = 4096
BUCKET_CELLS = 1 << 20
MARGIN = 1 + 1e-9

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Letters A-Z to lower case, all ASCII but letters and digits to spaces; bytes of other characters stay.
_TABLE = bytes(b if b > 127 or b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split() if text else []


@dataclass
class Item:
    item_id: int
    places: np.ndarray  # of its terms, ascending
    counts: np.ndarray
    limit: int = 0  # a score that k documents reach; 0 if unknown


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[Item], dict[bytes, int]]]:
    """Blocks of items with the places of their terms; the driver holds one block at a time."""
    asked = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    asked = asked.groupBy(F.col(item_id).cast("long").alias("item_id")).agg(F.min(text).alias("text")).orderBy("item_id")
    held: list[Item] = []
    places: dict[bytes, int] = {}
    size = 0
    for row in asked.toLocalIterator():
        counts = Counter(terms(row["text"].encode()))
        if not counts:
            continue
        if held and (len(held) >= BLOCK_ITEMS or size + len(row["text"]) > BLOCK_BYTES):
            yield held, places
            held, places, size = [], {}, 0
        size += len(row["text"])
        at = np.array([places.setdefault(t, len(places)) for t in counts], np.int64)
        order = np.argsort(at)
        held.append(Item(row["item_id"], at[order], np.array(list(counts.values()), np.int64)[order]))
    if held:
        yield held, places


def counted(docs: DataFrame, places: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of documents that have terms: all of them counted, those of the block listed."""
    known = docs.sparkSession.sparkContext.broadcast(places)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, ids, sizes, found, counts = known.value, [], [], [], []
        for i, words in zip(batch.column("doc_id").to_pylist(), map(terms, batch.column("text").to_pylist())):
            if not words:
                continue
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            some, times = np.unique(at[at >= 0], return_counts=True)
            ids.append(i)
            sizes.append(len(words))
            found.append(some.astype("<u4").tobytes())
            counts.append(times.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()),
                                           pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return staged(map_text(rows, run, "doc_id long, n long, terms binary, counts binary"))


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and the row each belongs to."""
    values = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), [len(v) // width for v in values])


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("terms"), "<u4")[0], minlength=n_terms)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["term", "df"])

    sums = rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    total = np.zeros(n_terms, np.int64)
    for row in sums.collect():  # one row a term of the block
        total[row["term"]] = row["df"]
    return total


def impact_vectors(rows: DataFrame, weights: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(doc_id, norm, terms, impacts) of documents with a term that weighs something."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = shared.value
            places, owner = _numbers(batch.column("terms"), "<u4")
            tf = _numbers(batch.column("counts"), "<u4")[0].astype(np.int64)
            n = batch.column("n").to_numpy()
            m = 25 + 75 * n * n_docs // max(1, n_words)
            impacts = weight[places] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
            norms = np.sqrt(np.bincount(owner, impacts.astype(np.float64) ** 2, len(n)))
            ends = np.cumsum(np.bincount(owner, minlength=len(n)))
            data, names = impacts.astype("<i8").tobytes(), batch.column("terms")
            cut = [data[8 * a : 8 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norms), names, pa.array(cut, pa.binary())],
                                             names=["doc_id", "norm", "terms", "impacts"])
            yield out.filter(pa.array(norms > 0))

    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, norm double, terms binary, impacts binary")


_BUCKET = "seq int, top double, ids binary, norms binary, sizes binary, terms binary, impacts binary"


def buckets(vectors: DataFrame, rows: int = BUCKET_ROWS, cells: int = BUCKET_CELLS) -> DataFrame:
    """Vectors in the order of their lengths, greatest first, packed into buckets; seq counts those of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        room = seq = 0

        def packed():
            ids, norms, places, impacts = zip(*held)
            values = [seq, norms[0], np.array(ids, "<i8").tobytes(), np.array(norms, "<f8").tobytes(),
                      np.array([len(p) // 4 for p in places], "<i8").tobytes(), b"".join(places), b"".join(impacts)]
            kinds = [pa.int32(), pa.float64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              names=[c.split()[0] for c in _BUCKET.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "norm", "terms", "impacts"))):
                held.append(row)
                room += len(row[2]) // 4
                if len(held) >= rows or room >= cells:
                    yield packed()
                    held, room, seq = [], 0, seq + 1
        if held:
            yield packed()

    order = [F.desc("norm"), F.asc("doc_id")]
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(vectors.repartitionByRange(spread, *order).sortWithinPartitions(*order).mapInArrow(run, _BUCKET))


class Bucket:
    """One bucket by rows and by terms."""

    def __init__(self, row: dict, n_terms: int):
        self.top = row["top"]
        self.ids, self.norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<f8")
        self.terms, self.impacts = np.frombuffer(row["terms"], "<u4"), np.frombuffer(row["impacts"], "<i8")
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))])
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))[order]
        self.sorted = self.impacts[order].astype(np.float64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=n_terms))])
        self.greatest = np.zeros(n_terms)
        present = np.flatnonzero(np.diff(self.starts))
        if len(present):
            self.greatest[present] = np.maximum.reduceat(self.sorted, self.starts[present])
        self.dense = np.zeros(n_terms, np.int64)

    def scores(self, item: Item, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.ends[rows] - first, sizes)
        self.dense[item.places] = item.counts
        gains = self.dense[self.terms[at]] * self.impacts[at]
        self.dense[item.places] = 0
        return np.add.reduceat(gains, first) if len(rows) else np.zeros(0, np.int64)

    def candidates(self, item: Item, limit: int) -> np.ndarray:
        """Rows whose bound reaches ``limit``."""
        if math.sqrt(float((item.counts**2).sum())) * self.top * MARGIN < limit:
            return np.zeros(0, np.int64)
        most = item.counts * self.greatest[item.places]
        order = np.argsort(-most, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])  # what the terms from here on add at most
        used = int(np.argmax(left * MARGIN < limit)) if limit else len(order)
        if limit and not used:
            return np.zeros(0, np.int64)
        first, counts = item.places[order[:used]], item.counts[order[:used]]
        where = [slice(self.starts[t], self.starts[t + 1]) for t in first.tolist()]
        rows = np.concatenate([self.rows[w] for w in where])
        gains = np.concatenate([self.sorted[w] for w in where])
        part = np.bincount(rows, gains * np.repeat(counts, [w.stop - w.start for w in where]), len(self.ids))
        seen = np.bincount(rows, gains * gains, len(self.ids))
        rest = math.sqrt(float((item.counts[order[used:]] ** 2).sum()))
        further = rest * np.sqrt(np.maximum(self.norms**2 * MARGIN - seen, 0.0))
        bound = (part + np.minimum(further, left[used])) * MARGIN
        return np.flatnonzero((part > 0) & (bound >= limit))


def search(found: DataFrame, items: list[Item], n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task's buckets for each item."""
    shared = found.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        asked = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                bucket = Bucket({c: batch.column(c)[r].as_py() for c in batch.schema.names}, n_terms)
                for place, item in enumerate(asked):
                    ids, scores = best.get(place, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    limit = max(item.limit, int(scores[-1]) if len(scores) == k else 0)
                    rows = bucket.candidates(item, limit)
                    if not len(rows):
                        continue
                    exact = bucket.scores(item, rows)
                    good = exact >= max(limit, 1)
                    ids, scores = np.concatenate([ids, bucket.ids[rows[good]]]), np.concatenate([scores, exact[good]])
                    order = np.lexsort((ids, -scores))[:k]
                    best[place] = (ids[order], scores[order])
        for place, (ids, scores) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), asked[place].item_id)), pa.array(ids), pa.array(scores)],
                                                 names=["item_id", "doc_id", "score"])

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    ranked = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for asked, places in item_blocks(items, item_id, item_text):
        rows = counted(docs, places, doc_id, text)
        n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(rows, len(places))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        packed = buckets(impact_vectors(rows, weights, n_docs, n_words))
        head = staged(best_of(search(packed.filter("seq = 0"), asked, len(places), k), k))
        limits = {r["item_id"]: r["score"] for r in head.filter(F.col("rank") == k).collect()}  # one row an item of the block
        for item in asked:
            item.limit = limits.get(item.item_id, 0)
        # Lengths below this cannot reach the limit of any item.
        least = min(i.limit / math.sqrt(float((i.counts**2).sum())) for i in asked) / MARGIN
        others = search(packed.filter((F.col("seq") > 0) & (F.col("top") >= least)), asked, len(places), k)
        found = best_of(head.select("item_id", "doc_id", "score").unionByName(others), k)
        ranked = ranked.unionByName(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return ranked
