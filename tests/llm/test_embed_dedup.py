import numpy as np

from docproof.llm import embed_dedup
from docproof.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, weight long, rep long"


def slow(rows, threshold=0.9):
    """(n_links, component_id) of each row by comparing all."""
    units = []
    for i, v in rows:
        ok = i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
        w = np.array(v, np.float64) if ok else None
        units.append(w / np.linalg.norm(w) if ok else None)
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return [(rows[a][0], links[a], least.get(find(a)), rows[a][0] is not None and rows[a][0] == least[find(a)]) for a in range(n)]


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 5, 6) for i, v in rows], SCHEMA)
    got = embed_dedup.near_duplicates(df, **how).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(slow(rows), key=repr)


def clusters(seed, sizes, noise, width=16):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        base = rng.standard_normal(width)
        out += [(base + noise * rng.standard_normal(width)).astype(np.float32) for _ in range(size)]
    return out


def test_edge_rows_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.1]), (10, [0.0, 1.0]), (11, [1.0]), (12, [1.0]), (13, [1.0, 0.0]),
            (13, [1.0, 0.0]), (14, [1e38, 0.0]), (15, [-1.0, 0.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(4, None)])


def test_clusters_equal_brute_force(spark):
    vectors = clusters(3, [60, 40, 5, 5, 3] + [1] * 200, 0.25)
    check(spark, [(i, v) for i, v in enumerate(vectors + vectors[:7])])


def test_grouped_trees_and_blocks(spark, monkeypatch):
    """With small groups, leaves and blocks, so that tops, spills and pairs of blocks are all in use."""
    vectors = clusters(5, [150, 90] + [2] * 60 + [1] * 300, 0.2)
    for name, value in (("GROUP_CELLS", 16), ("LEAF", 32), ("BLOCK", 40)):
        monkeypatch.setattr(embed_dedup, name, value)
    monkeypatch.setattr(embed_dedup._count_links, "__defaults__", (40,))
    check(spark, [(i, v) for i, v in enumerate(vectors)])


def test_recall_of_the_forest_alone(spark):
    vectors = [v.tolist() for v in clusters(7, [2] * 1500, 0.2, 64)]
    reps = spark.createDataFrame(list(enumerate(vectors)), "rep long, embedding array<float>")
    pairs = {(min(a, b), max(a, b)) for a, b in embed_dedup.forest_links(reps, len(vectors), 64).collect()}
    units = np.array(vectors)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(units @ units.T >= 0.9, 1)))}
    assert len(pairs & want) >= 0.99 * len(want) > 1000


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op4_embedding_dedup"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(slow(rows))
