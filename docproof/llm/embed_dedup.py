"""Embedding near-duplicates with a forest of random-projection trees.

Equal vectors become one representative with a weight. In each tree a node splits its vectors at the middle of a random
projection, and those near the middle go to both sides (spill). The top of each tree is fitted on a bounded sample
(``SAMPLE_ROWS``) and only deals vectors into groups of about ``GROUP_CELLS`` numbers; a top ends where 64 sampled
vectors are left, so beyond some 300 times that many vectors groups grow with the table. Every vector goes through it,
and each group is split further by its own vectors, down to leaves that are compared in full. Links found in a leaf are verified by their
cosine in double precision and given on as a spanning forest; the union over trees gives the components.

The links of a vector are then counted inside its component, in blocks: every pair of a component is compared, so what
the forest can miss are links between components it never saw connected.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with
nothing and stand for themselves; vectors of unlike length never link; repeated rows and ids are vectors like any
other and link if their vectors do; ties at the middle go by place, so halves are always halves; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import components, group_starts, map_groups, staged
from docproof.llm.topk import usable

COSINE = 0.9
TREES = 8
LEAF = 256
SPILL = 0.1
SAMPLE_ROWS = 20_000
GROUP_CELLS = 1 << 20
BLOCK = 2048


def _halves(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lower and upper half, both with the spill around the middle."""
    order = np.argsort(projected, kind="stable")
    middle, extra = len(order) // 2, max(1, int(SPILL * len(order)))
    return order[: middle + extra], order[middle - extra :]


class TreeTop:
    """The first levels of a tree: nodes as (direction, lower bound of the upper side, upper bound of the lower side)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.nodes: dict[int, tuple[np.ndarray, float, float]] = {}
        rng = np.random.default_rng(seed)
        todo = [(1, np.arange(len(sample)), depth)]
        while todo:
            node, rows, left = todo.pop()
            if not left or len(rows) < 64:
                continue
            direction = rng.standard_normal(sample.shape[1])
            projected = sample[rows] @ direction
            low, high = np.quantile(projected, [0.5 - SPILL, 0.5 + SPILL])
            self.nodes[node] = (direction, low, high)
            todo += [(2 * node, rows[projected <= high], left - 1), (2 * node + 1, rows[projected >= low], left - 1)]

    def deal(self, units: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Group and places of its vectors; a vector may be in several groups."""
        out, todo = [], [(1, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.nodes:
                out.append((node, rows))
                continue
            direction, low, high = self.nodes[node]
            projected = units[rows] @ direction
            todo += [(2 * node, rows[projected <= high]), (2 * node + 1, rows[projected >= low])]
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all of one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    # Scaled first, so that neither very large nor very small components lose their squares.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _leaf_links(units: np.ndarray, threshold: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that hold the linked vectors of every leaf together."""
    out, todo = [], [np.arange(len(units))]
    while todo:
        rows = todo.pop()
        if len(rows) > LEAF:
            todo += [rows[h] for h in _halves(units[rows] @ rng.standard_normal(units.shape[1]))]
            continue
        close = units[rows] @ units[rows].T >= threshold
        label = np.arange(len(rows))
        while True:
            least = np.minimum(label, np.where(close, label[None, :], len(rows)).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        linked = np.flatnonzero(label != np.arange(len(rows)))
        if len(linked):
            out.append((rows[linked], rows[label[linked]]))
    return out


def forest_links(reps: DataFrame, n: int, width: int, threshold: float = COSINE, trees: int = TREES) -> DataFrame:
    """Links (a, b) between representatives (rep, embedding) of one width that meet in a leaf of some tree."""
    spark = reps.sparkSession
    room = max(4 * LEAF, GROUP_CELLS // max(1, width))
    # With the spill each side keeps 0.5 + SPILL of its node, so halving alone would stop too early.
    depth = max(0, math.ceil(math.log(max(1, n) / room) / -math.log(0.5 + SPILL)))
    tops: list[TreeTop] = []
    if depth:
        drawn = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").toArrow()
        sample = _vectors(drawn.column("embedding").combine_chunks())
        tops = [TreeTop(sample, depth, seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast(tops)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _vectors(batch.column("embedding")) if shared.value else None
            for tree in range(trees):
                groups = shared.value[tree].deal(units) if shared.value else [(1, np.arange(batch.num_rows))]
                for group, rows in groups:
                    if len(rows):
                        part = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), tree, np.int32)), pa.array(np.full(len(rows), group, np.int64)),
                             part.column("rep"), part.column("embedding")],
                            names=["tree", "leaf", "rep", "embedding"],
                        )

    def search(rows: pa.Table) -> pa.Table | None:
        found_a, found_b = [], []
        starts = group_starts(rows, ["tree", "leaf"])
        for s, e in zip(starts, np.append(starts[1:], rows.num_rows)):
            part = rows.slice(s, e - s)
            reps_here = part.column("rep").to_numpy()
            order = np.argsort(reps_here)
            units = _vectors(part.column("embedding").combine_chunks())[order]
            reps_here = reps_here[order]
            rng = np.random.default_rng([int(part.column("tree")[0].as_py()), int(part.column("leaf")[0].as_py())])
            for a, b in _leaf_links(units, threshold, rng):
                found_a.append(reps_here[a])
                found_b.append(reps_here[b])
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)}) if found_a else None

    kind = dict(reps.dtypes)["embedding"]
    dealt = reps.select("rep", "embedding").mapInArrow(deal, f"tree int, leaf long, rep long, embedding {kind}")
    return map_groups(dealt, ["tree", "leaf"], search, "a long, b long")


def _count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(rep, n): weight of the other representatives of its component that each one links to."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = members.join(sizes, "root")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = sized.select("root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
                         "rep", "weight", "embedding")
    dealt = dealt.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep",
                         "weight", "embedding")
    keys = ["root", "a", "b"]

    def count(rows: pa.Table) -> pa.Table | None:
        reps, weights = rows.column("rep").to_numpy(), rows.column("weight").to_numpy().astype(float)
        first, second, own = (rows.column(c).to_numpy() for c in ("a", "b", "own"))
        found = np.zeros(rows.num_rows)
        starts = group_starts(rows, keys)
        for s, e in zip(starts, np.append(starts[1:], rows.num_rows)):
            units = _vectors(rows.column("embedding").slice(s, e - s).combine_chunks())
            w = weights[s:e]
            if first[s] == second[s]:
                close = units @ units.T >= threshold
                np.fill_diagonal(close, False)
                found[s:e] = close @ w
            else:
                left = own[s:e] == first[s]
                close = units[left] @ units[~left].T >= threshold
                part = np.zeros(e - s)
                part[left], part[~left] = close @ w[~left], w[left] @ close
                found[s:e] = part
        return pa.table({"rep": reps, "n": np.rint(found).astype(np.int64)})

    return map_groups(dealt, keys, count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, trees: int = TREES, vec_id: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    sound = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    sound = F.coalesce(sound, F.lit(False))
    distinct = rows.filter(sound).groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    reps = staged(distinct.select(F.monotonically_increasing_id().alias("rep"), "weight", "first_id", "embedding"))
    edges = None
    # Vectors of unlike length have no cosine; lengths are few, one for each model that made them.
    for width, n in sorted((r["width"], r["count"]) for r in reps.groupBy(F.size("embedding").alias("width")).count().collect()):
        found = forest_links(reps.filter(F.size("embedding") == width), n, width, threshold, trees)
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    roots = staged(components(edges).select(F.col("node").alias("rep"), "root"))
    counted = _count_links(reps.join(roots, "rep").select("rep", "root", "weight", "embedding"), threshold)
    rooted = reps.select("rep", "weight", "first_id").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_rep = rooted.join(least, "root").join(counted, "rep", "left").select(
        "rep", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    known = reps.select("rep", "embedding").join(per_rep, "rep").select("embedding", "n_links", "component_id")
    linked = rows.filter(sound).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
