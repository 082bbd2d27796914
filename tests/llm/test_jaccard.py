import random
import re
from fractions import Fraction

from helpers import EDGES, documents

import corpus_pipeline
from docproof.llm import jaccard, simhash
from docproof.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)


def survivors(rows):
    """Ids that stand for their component, by comparing all pairs."""
    rows = sorted(r for r in rows if r[0] is not None)
    sets = [shingles(t) for _, t in rows]
    roots = list(range(len(rows)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                p, q = find(i), find(j)
                roots[max(p, q)] = min(p, q)
    return sorted(rows[i][0] for i in {find(i) for i in range(len(rows))})


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randrange(10**9)}"
    return out


def corpus():
    """Near copies around 0.8, chains of them, a passage and lines that unlike texts share."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice((30, 64, 200)))]
        texts += [edited(rnd, base, rnd.randint(0, max(1, len(base) // 40))) for _ in range(6)]
        for _ in range(4):
            base = edited(rnd, base, 1)
            texts.append(base)
    texts += [passage + [word() for _ in range(rnd.randint(5, 60))] for _ in range(30)]
    rnd.shuffle(texts)
    return list(enumerate(map(" ".join, texts), 1))


def test_the_stage_equals_all_pairs(spark):
    rows = corpus()
    want = survivors(rows)
    found = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in found.collect()) == want
    assert len(want) < simhash.keep_one(documents(spark, rows)).count()


def test_fingerprints_link_first(spark, monkeypatch):
    texts = corpus()
    base = texts[0][1].split()
    texts += [(900 + i, " ".join([*base, *base[:i]])) for i in range(3)] + [(990, None), (991, " ")]
    found, real = [], jaccard.simhash_links
    monkeypatch.setattr(jaccard, "simhash_links", lambda *a: found.append(real(*a)) or found[-1])
    kept = corpus_pipeline.near_dedup(spark, documents(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(texts)
    sets, prints = {}, {}
    for _, text in texts:
        key = int(jaccard.np.array([jaccard.set_key(jaccard.shingle_set(text))], jaccard.np.uint64).view(jaccard.np.int64)[0])
        sets[key] = jaccard.shingle_set(text)
        prints.setdefault(key, set()).add(int(simhash.fingerprints([text or ""])[0]))
    pairs = [(r["a"], r["b"]) for r in found[0].collect()]
    assert pairs
    for a, b in pairs:
        assert jaccard.similar(sets[a], sets[b])
        assert min((x ^ y).bit_count() for x in prints[a] for y in prints[b]) <= simhash.RADIUS


def test_groups_of_fingerprints_are_compared_whole(spark, monkeypatch):
    """Not only with one text of each fingerprint: here nothing but operator 5's groups is compared."""
    tails = [[f"t{i}x{j}" for j in range(40)] for i in range(30)]
    phrase = "one two three four five".split() * 60
    rows = [(2 * i + k, " ".join([*phrase, *tail, *["end"] * k])) for i, tail in enumerate(tails) for k in (0, 1)]
    assert len({int(simhash.fingerprints([t])[0]) for _, t in rows}) == 1
    monkeypatch.setattr(jaccard, "group_members", lambda prefixes, order: prefixes.select(prefixes.row.alias("gid"), "key", "n").limit(0))
    for block in (2048, 7):
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
        kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
        assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows) == list(range(0, 60, 2))


def test_any_order_of_shingles_finds_all(spark, monkeypatch):
    rows = corpus()
    for common, block, hot, partners in ((10**6, 3, 200_000, 2), (2, 4, 5, 1)):
        monkeypatch.setattr(jaccard, "COMMON", common)
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
        monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
        monkeypatch.setattr(jaccard, "PARTNERS", partners)
        assert sorted(r["doc_id"] for r in jaccard.keep_one(documents(spark, rows)).collect()) == survivors(rows)


def test_exactly_the_least_similarity_links():
    a = jaccard.np.arange(9, dtype=jaccard.np.uint64)
    assert jaccard.similar(a[:8], jaccard.np.append(a[:8], [20, 21]).astype(a.dtype))
    assert not jaccard.similar(a[:7], jaccard.np.append(a[:7], [20, 21]).astype(a.dtype))
    assert [len(jaccard.prefix(a[:n], a[:0])) for n in (0, 1, 4, 5, 9)] == [0, 1, 1, 2, 2]


def test_edge_rows(spark):
    docs = documents(spark, EDGES + [(None, None)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 8, 9, 10]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == survivors(rows)


def test_an_id_with_unlike_texts_stands_for_each_group(spark):
    old, new = "the first text of a page fetched early", "quite another page was found there some days later"
    rows = [(3, old), (3, new), (3, new), (1, old), (7, new), (4, "x y z"), (4, "u v w")]
    found = [jaccard.keep_one(documents(spark, part)).collect() for part in (rows, rows[::-1])]
    for kept in found:
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, old), (3, new), (4, "u v w"), (4, "x y z")]


def test_sketches_bound_what_is_not_shared():
    np = jaccard.np
    rng = np.random.default_rng(2)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(0, 90)).astype(np.uint64)]))
        a, b = jaccard.sketch(base), jaccard.sketch(other)
        width = min(len(a), len(b))
        bits = jaccard.folded(jaccard._bits(a), width) ^ jaccard.folded(jaccard._bits(b), width)
        apart = np.bitwise_count(bits).sum(axis=1)
        assert apart[0] <= len(np.setxor1d(base, other))
        if jaccard.similar(base, other):
            assert jaccard.can_link(np.array([len(base)]), len(other), apart).all()
    assert len(jaccard.sketch(np.zeros(0, np.uint64))) == 8
