import hashlib
import math
import zlib
from collections import Counter

import pytest
from helpers import EDGES, documents

from docproof.llm import shards
from docproof.llm.queries import QUERIES


def slow_shard(key, weights):
    def score(i):
        digest = hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[: shards.DIGITS]
        return -math.log((int(digest, 16) + 0.5) / 16**shards.DIGITS) / weights[i]

    return min(range(len(weights)), key=score)


def check(rows, texts, weights):
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    given = dict(texts)
    for r in rows:
        data = (given[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == slow_shard(r["doc_id"], weights)
        assert r["grown_shard"] == slow_shard(r["doc_id"], [*weights, 1.0])
        assert r["grown_shard"] in (r["shard"], len(weights))
    for s in {r["shard"] for r in rows}:
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert ids == sorted(ids)


def test_edge_rows_and_extra_columns(spark):
    weights = [1.0, 2.0, 0.5]
    docs = documents(spark, EDGES)
    check(shards.shard_records(docs, weights).collect(), EDGES, weights)
    assert shards.shard_records(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        shards.shard_records(docs, [1.0, 0.0])


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op10_sharding"](spark, folder).collect()
    check(rows, texts, [1.0] * 16)
    moved = sum(r["shard"] != r["grown_shard"] for r in rows)
    assert 0.02 < moved / len(rows) < 0.12


def test_shares_follow_weights(spark):
    ids = spark.range(20_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    found = {r["shard"]: r["count"] for r in shards.assign(ids, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.73 < found[1] / 20_000 < 0.77


def test_one_id_in_most_rows_still_gets_gapless_slots(spark):
    ids = spark.range(3_000).selectExpr("IF(id % 3 = 0, id, 7) AS doc_id", "'t' AS text")
    rows = shards.shard_records(ids, [1.0] * 4).collect()
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
