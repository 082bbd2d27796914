"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, one term per component. Queries are searched in runs of at most
``RUN_BYTES`` (one block at least), broadcast to the tasks; every run is one pass over the candidates, which stay where
they are stored. A task turns each block of its candidates into postings once a run: for every term the rows that hold
it and their weights. For each term it scatters query weight times posting weight into dense score arrays, selects the
k best by partition and merges them with what its earlier blocks gave; only the k best of a task for each query are
shuffled, to be merged by query. Work is queries times candidates, in bounded blocks.

Edge cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; vectors
of unlike length are sparse rows, absent terms weigh nothing; ties go to the smaller id; rows with the query's id are
the query's own; a repeated query id is searched once, with its smallest vector, while repeated candidates each count;
fewer than k candidates are all returned; empty tables give empty results. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import discard, staged

BLOCK_ROWS = 2048
QUERY_SLAB = 64
RUN_BYTES = 32 << 20  # of query weights broadcast at a time


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the rows (none: every row of the block) and their weights."""
    out = []
    for column in np.ascontiguousarray(matrix.T):
        rows = np.flatnonzero(column)
        out.append((None, column) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def _top(ids: np.ndarray, candidates: np.ndarray, queries: np.ndarray, postings: list, k: int):
    """Best k of one block for each query: (query ids, candidate ids, scores). Candidates are in order of id."""
    n = len(candidates)
    found = []
    for at in range(0, len(ids), QUERY_SLAB):
        names, rows = ids[at : at + QUERY_SLAB], queries[at : at + QUERY_SLAB]
        scores = np.zeros((len(rows), n), np.int64)
        for term, (where, weights) in enumerate(postings):
            if term >= rows.shape[1]:
                break
            holders = np.flatnonzero(rows[:, term])
            if not len(holders) or not len(weights):
                continue
            gain = np.multiply.outer(rows[holders, term], weights)
            if where is None and len(holders) == len(rows):
                scores += gain
            elif where is None:
                scores[holders] += gain
            else:
                scores[np.ix_(holders, where)] += gain
        own = names[:, None] == candidates[None, :]
        low = np.iinfo(np.int64).min
        scores[own] = low
        if n > k:
            least = np.partition(scores, n - k, axis=1)[:, n - k]
            hit = (scores >= least[:, None]) & ~own
        else:
            hit = ~own
        q, c = np.nonzero(hit)
        s = scores[q, c]
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.searchsorted(q, q, side="left")
        best = np.arange(len(q)) - first < k
        found.append((names[q[best]], candidates[c[best]], s[best]))
    return found


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of a table (vec_id, weights), rows in order of id, short rows filled with zeros."""
    whole = rows.combine_chunks()
    ids = whole.column("vec_id").to_numpy()
    vectors = whole.column("weights").combine_chunks()
    widths = np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((len(ids), int(widths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(ids)), widths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(widths) - widths, widths)
    matrix[row, column] = vectors.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def _pack(batches):
    """All rows of one partition as one block: ids and weights."""
    from pyspark import TaskContext

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    ids, matrix = _matrix(pa.Table.from_batches(parts))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([TaskContext.get().partitionId()], pa.int32()),
            pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            pa.array([matrix.astype("<i8").tobytes()], pa.binary()),
            pa.array([matrix.shape[1]], pa.int32()),
        ],
        names=["block", "ids", "weights", "width"],
    )


def _runs(asked: DataFrame, rows: int, run_bytes: int):
    """The queries in lists of blocks (ids, weights), each list of at most ``run_bytes`` or of one block."""
    n = max(1, -(-asked.count() // rows))
    blocks = staged(asked.repartition(n).mapInArrow(_pack, "block int, ids binary, weights binary, width int"))
    largest = blocks.agg(F.max(F.octet_length("weights") + F.octet_length("ids"))).first()[0] or 1
    step = max(1, run_bytes // largest)
    for at in range(0, n, step):
        found = blocks.filter(F.col("block").between(at, at + step - 1)).collect()
        if found:
            ids = [np.frombuffer(r["ids"], "<i8") for r in found]
            yield [(i, np.frombuffer(r["weights"], "<i8").reshape(len(i), r["width"])) for i, r in zip(ids, found)]
    discard(blocks)


def _best(names: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query, higher scores and then smaller ids first."""
    order = np.lexsort((found, -scores, names))
    names, found, scores = names[order], found[order], scores[order]
    best = np.arange(len(names)) - np.searchsorted(names, names, side="left") < k
    return names[best], found[best], scores[best]


def _search(candidates: DataFrame, run: list, k: int, rows: int) -> DataFrame:
    """The k best of the candidates for every query of a run; written, as the run is given back afterwards."""
    shared = candidates.sparkSession.sparkContext.broadcast(run)

    def search(batches):
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, matrix = _matrix(pa.Table.from_batches([batch.slice(at, rows)]))
                postings = _postings(matrix)
                found = [part for names, queries in shared.value for part in _top(names, ids, queries, postings, k)]
                held = _best(*(np.concatenate(parts) for parts in zip(held, *found)), k)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], names=["query_id", "vec_id", "score"])

    partial = candidates.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    done = staged(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    shared.destroy()
    return done


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0, rows: int = BLOCK_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row."""
    spark = vectors.sparkSession
    sound = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    sparse = staged(sound.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(vector), scale).alias("weights"),
                                 F.coalesce(is_query, F.lit(False)).alias("asks")))
    asked = sparse.filter("asks").groupBy("vec_id").agg(F.min("weights").alias("weights"))
    candidates = sparse.select("vec_id", "weights")
    done = [_search(candidates, run, k, rows) for run in _runs(asked, rows, run_bytes)]
    discard(sparse)
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(done[0].schema).parquet(*(f"{d.staged_path}/t" for d in done))
