import math
import random
import re
from collections import Counter

import pytest
from helpers import EDGES, documents

from docproof.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def slow(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t), key=lambda x: x.encode())
    out = []
    for i, text in asked.items():
        scored = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, n in Counter(words(text)).items() if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def find(spark, docs, items, k=10):
    asked = spark.createDataFrame([(i, t, 1.0, 2) for i, t in items], "item_id long, text string, score double, rank int")
    return sorted(map(tuple, lexical.rank_documents(documents(spark, docs), asked, k).collect()))


def corpus(seed, n):
    rnd = random.Random(seed)
    names = ["w" + str(int(rnd.paretovariate(0.6))) for _ in range(400)]
    docs = [(i, " ".join(rnd.choices(names, k=rnd.choice([0, 3, 20, 200])))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)] + [(n + 50 + i, docs[2][1] + " tail" + str(i % 3)) for i in range(30)]
    items = [(i, " ".join(rnd.choices(names, k=rnd.choice([1, 5, 60])))) for i in range(30)] + [(90, docs[5][1]), (91, docs[2][1] * 2)]
    return docs, items


@pytest.mark.parametrize("rows,cells", [(lexical.BUCKET_ROWS, lexical.BUCKET_CELLS), (7, 1 << 20), (50, 40)])
def test_like_brute_force(spark, monkeypatch, rows, cells):
    plain = lexical.buckets
    monkeypatch.setattr(lexical, "buckets", lambda vectors: plain(vectors, rows, cells))
    docs, items = corpus(1, 300)
    assert find(spark, docs, items) == slow(docs, items)
    assert find(spark, docs, items, 3) == slow(docs, items, 3)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(2, 80)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert find(spark, docs, items) == slow(docs, items)


def test_edges(spark):
    items = [(1, None), (2, ""), (3, "!!"), (4, "WORD"), (5, "lorem ipsum dolor"), (6, "same same here"), (7, "été ünïcode 漢字 😀"), (None, "word"),
             (8, "absent"), (9, "id at all"), (10, "same text"), (10, "here"), (11, "Été Ünïcode")]
    assert find(spark, EDGES, items) == slow(EDGES, items)
    assert find(spark, [], items) == [] and find(spark, EDGES, []) == []
    assert find(spark, [(1, "a a b"), (2, None)], [(1, "a")]) == slow([(1, "a a b"), (2, None)], [(1, "a")])


def test_buckets_are_passed_over(monkeypatch):
    """With a limit that only the copies reach, short vectors are not looked at and few others scored."""
    import numpy as np

    rng = np.random.default_rng(0)
    places = [np.sort(rng.choice(500, 30, replace=False)).astype("<u4") for _ in range(200)]
    impacts = [rng.integers(1000, 100_000, 30) for _ in range(200)]
    norms = [math.sqrt(float((v**2).sum())) for v in impacts]
    row = {"top": max(norms), "ids": np.arange(200, dtype="<i8").tobytes(), "norms": np.array(norms).tobytes(),
           "sizes": np.full(200, 30, "<i8").tobytes(), "terms": b"".join(p.tobytes() for p in places),
           "impacts": b"".join(v.astype("<i8").tobytes() for v in impacts)}
    bucket = lexical.Bucket(row, 500)
    item = lexical.Item(1, places[3].astype(np.int64), np.ones(30, np.int64))
    dense = np.zeros((200, 500), np.int64)
    for i in range(200):
        dense[i, places[i]] = impacts[i]
    exact = dense[:, places[3]].sum(axis=1)
    assert (bucket.scores(item, np.arange(200)) == exact).all()
    for limit in (0, 1, int(np.median(exact)), int(exact.max()), int(exact.max()) + 1):
        kept = bucket.candidates(item, limit)
        assert set(np.flatnonzero((exact >= limit) & (exact > 0))) <= set(kept)
    assert len(bucket.candidates(item, int(exact.max()))) < 20
    assert not len(bucket.candidates(item, 10**12))
