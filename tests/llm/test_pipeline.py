from collections import Counter

import pytest
from helpers import EDGES, documents
from test_jaccard import survivors

import corpus_pipeline
from docproof.llm import language, mixing, pieces, quality
from docproof.llm.common import remainder, staged, table
from docproof.llm.queries import DOMAIN_TARGETS, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, staged(stage(spark, docs, FOLDER))))
        docs = out[-1][1]
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_against_its_own_input(spark, outputs):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = outputs
    assert d0.columns == d1.columns == d2.columns == d3.columns == d4.columns
    model = quality.fit(d0, table(spark, FOLDER, "labels").filter(remainder(quality.F.col("doc_id"), 4) != 2))
    rows = d0.collect()
    scores = model.predict(quality.statistics([r["text"] or "" for r in rows]))
    assert ids(d1) == Counter(r["doc_id"] for r, s in zip(rows, scores) if s >= 0.7)

    parsed = language.fit(d1.filter(remainder(quality.F.col("doc_id"), 5) != 0))
    rows = d1.collect()
    names, scores = parsed.predict([r["text"] or "" for r in rows])
    assert ids(d2) == Counter(r["doc_id"] for r, n, s in zip(rows, names, scores) if n != "und" and s >= language.LEAST_SCORE)

    assert ids(d3) == Counter(survivors([(r["doc_id"], r["text"]) for r in d2.collect()]))

    labelled = d3.withColumnRenamed("lang", "domain")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(d3, labelled, DOMAIN_TARGETS).collect()}
    assert ids(d4) == Counter(want) and min(want.values()) >= 1

    plain = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in d4.collect()}
    assert ids(d5) == ids(d4)
    for r in d5.collect():
        (want_ids, spans), = plain.encode([texts[r["doc_id"]]])
        assert r["ids"] == want_ids.tolist() and r["starts"] == spans[:, 0].tolist() and r["decoded"] == texts[r["doc_id"]]


def test_edge_rows_pass_through_every_stage(spark):
    docs = documents(spark, EDGES)
    for _, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, FOLDER)
            rows = out.collect()
            assert (out.columns == docs.columns) or "ids" in out.columns
            assert rows or not part.count() or stage is corpus_pipeline.quality_filter
            kept, given = Counter(r["doc_id"] for r in rows), Counter(r[0] for r in EDGES) if part is docs else Counter()
            if stage is corpus_pipeline.near_dedup:
                assert kept == Counter([1, 4, 5, 6, 8, 9, 10, None] if given else [])
            elif stage is corpus_pipeline.encode:
                assert kept == given
            elif stage is corpus_pipeline.mix_domains:
                assert set(kept) == set(given) and all(kept[i] >= given[i] for i in given)
            else:
                assert kept <= given
