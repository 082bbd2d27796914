import numpy as np
import pytest
from helpers import EDGES, documents

from docproof.llm import quality
from docproof.llm.queries import QUERIES


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "One two two three.\nFour!", "A  B\t\tC", "x" * 5000, "ABC DEF *** 12", "é É 漢字 \x1c", " lead", "trail "]
    together = quality.statistics(texts)
    for row, text in zip(together, texts):
        assert np.array_equal(row, quality.statistics([text])[0]), text
    assert not together[0].any() or np.isfinite(together).all()
    words = quality.statistics(["a b b c"])[0]
    assert 0.75 in words and 0.25 in words  # three of four words are distinct, one repeats its neighbour


def test_flat_trees_walk_as_written():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.grow(x, y, trees=20, depth=3)

    def one(row):
        total = model.base
        for f, t, v in zip(model.features, model.thresholds, model.values):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.predict(x[:50]), [one(r) for r in x[:50]])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97


def test_labels_of_one_kind_and_none():
    x = np.zeros((4, 2))
    assert quality.grow(x, np.ones(4)).predict(x)[0] == pytest.approx(5 / 6)
    assert quality.grow(np.zeros((0, 1)), np.zeros(0)).predict(x)[0] == 0.5


def test_edge_rows_and_extra_columns(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (6, None, 1), (None, 1, 1), (7, 1, 0), (7, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.predict(docs, model, [docs["doc_id"], docs["score"].alias("theirs")]).collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["theirs"] == 1.5 for r in rows)
    kept = quality.accepted(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(EDGES)
    none = quality.fit(docs.limit(0), labels)
    assert {r["score"] for r in quality.predict(docs, none, [docs["doc_id"]]).collect()} == {0.5}
    assert quality.predict(docs.limit(0), model, [docs["doc_id"]]).count() == 0


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([g > b for g in good for b in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_trees_split_where_an_exhaustive_search_does():
    rng = np.random.default_rng(11)
    for _ in range(5):
        x = rng.integers(0, 6, size=(40, 3)).astype(float)
        y = ((x[:, 0] + x[:, 2] > 5) ^ (rng.random(40) < 0.1)).astype(float)
        depth = 2
        model = quality.grow(x, y, trees=4, depth=depth, rate=0.3, bins=64)
        score = [model.base] * len(x)
        assert model.base == pytest.approx(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

        def weight(rows, first, second):
            return sum(first[i] for i in rows), sum(second[i] for i in rows)

        for features, thresholds, values in zip(model.features, model.thresholds, model.values):
            p = [1 / (1 + np.exp(-s)) for s in score]
            g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
            at = {0: list(range(len(x)))}
            for node in range((1 << depth) - 1):
                rows = at.pop(node)
                all_g, all_h = weight(rows, g, h)

                def gain(feature, cut):
                    left = [i for i in rows if x[i, feature] <= cut]
                    a, b = weight(left, g, h)
                    c, d = all_g - a, all_h - b
                    if b < 1 or d < 1:
                        return 0.0
                    return a * a / (b + quality.L2) + c * c / (d + quality.L2) - all_g**2 / (all_h + quality.L2)

                best = max(gain(f, cut) for f in range(3) for cut in range(6))
                chosen = gain(features[node], thresholds[node])
                assert chosen == pytest.approx(max(best, 0.0) if best > 1e-6 else 0.0, abs=1e-9)
                at[2 * node + 1] = [i for i in rows if x[i, features[node]] <= thresholds[node]]
                at[2 * node + 2] = [i for i in rows if x[i, features[node]] > thresholds[node]]
            for leaf, value in enumerate(values):
                rows = at[(1 << depth) - 1 + leaf]
                a, b = weight(rows, g, h)
                assert value == pytest.approx(-0.3 * a / (b + quality.L2))
                for i in rows:
                    score[i] += value
        assert np.allclose(model.predict(x), 1 / (1 + np.exp(-np.array(score))))
