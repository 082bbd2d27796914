import numpy as np
import pytest
from helpers import EDGES, documents
from pyspark.sql import functions as F

from docproof.llm import mixing
from docproof.llm.common import staged
from docproof.llm.queries import DOMAIN_TARGETS, QUERIES


def test_posteriors_do_not_depend_on_neighbours():
    model = mixing.DomainModel({"a": ["banana ananas", "ban a nab"], "b": ["xyz zyx", "zz top"]})
    texts = ["", "banana", "zyx zyx", "a", "é漢"]
    together = model.posteriors(texts)
    assert np.allclose(together.sum(axis=1), 1)
    for row, t in zip(together, texts):
        assert np.allclose(row, model.posteriors([t])[0])
    assert together[1, 0] > 0.5 > together[2, 0]


def test_rates_solve_the_least_squares(spark):
    """Against the same problem solved by plain projected gradient in one process."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.3, 0.5], 200)
    n = rng.integers(1, 500, 200)
    rows = [(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(n, p))]
    members = staged(spark.createDataFrame(rows, "doc_id long, n_tokens long, posteriors array<double>"))
    for least, targets in ((1.0, [0.4, 0.3, 0.3]), (0.0, [0.9, 0.05, 0.05])):
        names = ["a", "b", "c"]
        steps = mixing.fit_rates(members, names, dict(zip(names, targets)), least)
        rates = mixing.rates_after(steps, p, least)
        assert (rates >= least).all()
        total = mixing.HEADROOM * ((n @ p) / np.array(targets)).max()
        goal = np.array(targets) * total
        plain = np.ones(200)
        size = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / total).max()
        for _ in range(20_000):
            plain = np.maximum(least, plain - size * p @ (((plain * n) @ p - goal) / total))
        mine, best = (np.abs((r * n) @ p - goal).max() / total for r in (rates, plain))
        assert mine <= best + 1e-4


def test_edge_rows_and_extra_columns(spark):
    docs = documents(spark, [(i, t, "a" if k % 2 else "b") for k, (i, t) in enumerate(EDGES)])
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    rows = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5, "never": 0.3}).collect()
    assert len(rows) == len(EDGES)
    assert all(r["rate"] >= 1 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    assert all(r["rate"] == 1.0 and r["copies"] == 1 for r in rows if r["n_tokens"] == 0)
    out = mixing.mixed_documents(docs, labelled, {"a": 0.5, "b": 0.5})
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}).collect()}
    found = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {i: c * (2 if i == 7 else 1) for i, c in copies.items()}
    for none in (labelled.limit(0), labelled.withColumn("domain", F.lit(None).cast("string"))):
        assert {r["rate"] for r in mixing.mix(docs, none, {"a": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, {"a": 1.0}).count() == 0
    assert mixing.mixed_documents(docs.limit(0), labelled.limit(0), {"a": 1.0}).count() == 0


def test_query_meets_the_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op9_mixing"](spark, folder).collect()
    used = {}
    for r in rows:
        used[r["domain"]] = used.get(r["domain"], 0.0) + r["rate"] * r["n_tokens"]
    total = sum(used.values())
    for name, share in DOMAIN_TARGETS.items():
        assert used[name] / total == pytest.approx(share, abs=0.01)
    assert min(r["copies"] for r in rows) >= 1 and len({r["doc_id"] for r in rows}) == len(rows) == 1000
