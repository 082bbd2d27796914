import math
import random

from pyspark.sql import functions as F

from docproof.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def slow(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sound:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 9) for i, v in rows], SCHEMA)


def find(df, k=5, rows=topk.BLOCK_ROWS, run_bytes=topk.RUN_BYTES):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k, rows=rows, run_bytes=run_bytes).collect()))


def as_floats(rows):
    """The values as the column stores them."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_edges_ties_and_unlike_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (3, None), (4, [nan, 1.0, 0.0]), (5, [inf, 0.0, 0.0]),
            (6, [None, 1.0, 1.0]), (7, [1.0]), (8, []), (50, [0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (100, [-1.0, 0.001, -0.001, 4.0]),
            (1, [0.5, 0.5, 0.5]), (50, [0.0, 0.0, 1.0]), (150, None)]
    rows = as_floats(rows)
    assert find(frame(spark, rows)) == slow(rows, 5)
    assert find(frame(spark, rows[:2])) == slow(rows[:2], 5)
    assert find(frame(spark, [])) == []
    assert find(frame(spark, rows[1:3])) == []


def test_many_blocks_sparse_and_dense_terms(spark):
    rnd = random.Random(4)
    rows = as_floats([(i, [rnd.choice([0.0, rnd.uniform(-1, 1)]) if d % 2 else rnd.choice([0.0, 0.0, 0.0, rnd.choice([-1.0, 0.25])])
                           for d in range(12)]) for i in range(400)])
    assert find(frame(spark, rows), 7, rows=37) == slow(rows, 7)


def test_runs_of_queries_give_the_same(spark):
    rnd = random.Random(8)
    rows = as_floats([(i % 900, [rnd.choice([0.0, 0.5, -0.5, rnd.uniform(-1, 1)]) for _ in range(5)]) for i in range(1000)])
    df = frame(spark, rows).repartition(3)
    want = slow(rows, 4)
    assert find(df, 4, rows=5, run_bytes=1) == want  # every block of queries is a run
    assert find(df, 4, rows=5, run_bytes=500) == want


def test_a_task_merges_its_blocks(spark):
    rows = as_floats([(i, [0.1 * i, 1.0]) for i in range(120)])
    candidates = frame(spark, rows).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("weights"))
    run = next(topk._runs(candidates.filter("vec_id % 50 = 0"), 2, topk.RUN_BYTES))
    assert sorted(i for ids, _ in run for i in ids) == [0, 50, 100]
    found = topk._search(candidates.coalesce(1), run, 3, 16)
    assert found.count() == 9
