import random
import re

import numpy as np
import xxhash
from helpers import EDGES, documents

from docproof.llm import simhash
from docproof.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, radius=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    texts = ["", " \t ", "One", "one TWO", "One two three", "É é x y z", "a b c a b c a b c", "x\x0by\x0cz\x1cw v", "q " * 300]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_counts_run_across_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 50)
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefg") + str(rnd.randint(0, 9)) for _ in range(n)) for n in (3, 200, 0, 49, 52, 1, 120)]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_tree_finds_all_within_the_radius():
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for b in base for _ in range(30)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:100] + [rnd.getrandbits(64)]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_links_hold_every_component_together_in_any_cut(spark):
    """Also where shards are cut into pieces and with more blocks."""
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = list({(b ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))})) & (1 << 64) - 1 for b in base for _ in range(25)})
    want = slow_roots(values)
    prints = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    for blocks, nodes in ((4, 4096), (4, 5), (6, 8)):
        found = simhash.links(prints, 3, blocks, nodes).collect()
        at = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
        parent = list(range(len(values)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found:
            a, b = at[r["a"]], at[r["b"]]
            assert (values[a] ^ values[b]).bit_count() <= 3
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
        assert [find(i) for i in range(len(values))] == want, (blocks, nodes)


def test_blocks_follow_the_size():
    assert simhash.block_count(1_000) == 4 and simhash.block_count(10**9) == 5 and simhash.block_count(10**12) == 6


def check(rows, texts):
    values = [slow_fingerprint(t) for _, t in texts]
    roots = slow_roots(values)
    ids = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    want = sorted(((i, f"{v:016x}", ids.get(r)) for (i, _), v, r in zip(texts, values, roots)), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want


def test_edge_rows_and_extra_columns(spark):
    docs = documents(spark, EDGES + [(None, None)])
    found = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_text(simhash.F.col("fp")), "component_id")
    check(found.collect(), EDGES + [(None, None)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 8, 9, 10]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0


def test_a_repeated_row_is_kept_once(spark):
    docs = documents(spark, [(3, "only this one text"), (3, "only this one text"), (5, "Only this one TEXT")])
    assert [r["doc_id"] for r in simhash.keep_one(docs).collect()] == [3]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(QUERIES["op5_simhash"](spark, folder).collect(), texts)


def test_an_id_with_unlike_texts_stands_for_each_group(spark):
    old, new = "the first text of a page fetched early", "quite another page was found there some days later"
    rows = [(3, old), (3, new), (3, new), (1, old), (7, new), (4, "x y z"), (4, "u v w")]
    found = [simhash.keep_one(documents(spark, part)).collect() for part in (rows, rows[::-1])]
    for kept in found:
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, old), (3, new), (4, "u v w"), (4, "x y z")]
