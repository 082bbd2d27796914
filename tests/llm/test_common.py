import random

import pyarrow as pa

from docproof.llm import common


def test_components_of_random_chain_and_star_links(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(30)] + [(7, 7), (-5, -9), (-9, 3)]
    links += links[:10] + [(b, a) for a, b in links[:10]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = sorted(map(tuple, common.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == sorted((x, find(x)) for x in list(parent))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contracted_links_keep_components_and_nodes_and_need_one_round(spark, monkeypatch):
    rnd = random.Random(4)
    links = [(2000 + i, 2001 + i) for i in range(300)] + [(rnd.randint(-50, 900), rnd.randint(-50, 900)) for _ in range(400)] + [(5, 5)]
    rnd.shuffle(links)
    edges = spark.createDataFrame(links, "a long, b long")
    want = sorted(map(tuple, common.components(edges).collect()))
    for parts, limit in ((1, 1 << 17), (1, 1), (4, 1 << 17), (16, 10)):
        fewer = common.contracted(edges.repartition(parts), limit)
        assert sorted(map(tuple, common.components(fewer).collect())) == want
        assert parts > 1 or limit == 1 or fewer.count() == sum(a != b for a, b in want)
    written, real = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df: written.append(1) or real(df))
    common.components(common.contracted(edges.coalesce(1)))
    assert len(written) == 2
    assert common.contracted(edges.limit(0)).count() == 0


def test_groups_stay_whole(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 7 AS INT) AS k", "CAST(id % 3 AS INT) AS j")

    def fn(rows):
        starts = common.group_starts(rows, ["k", "j"])
        ends = [*starts[1:], rows.num_rows]
        return pa.table({"k": rows.column("k").take(pa.array(starts)), "n": pa.array([int(e - s) for s, e in zip(starts, ends)])})

    found = common.map_groups(df, ["k", "j"], fn, "k int, n long", rows=100).collect()
    assert len(found) == 21 and sum(r["n"] for r in found) == 5000


def test_slices_cover_all_rows_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 100, 3, 3, 3, 50)] + [None]})
    parts = list(common.slices(iter([batch]), "text", 10))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 2
