"""Streams give what the batch operators give."""

import datetime as dtm
import time

import pytest
from pyspark.sql import functions as F

from docproof.operators.assembly import assemble_token_stream
from docproof.plans import bindings, process
from docproof.plans.queries import _stored
from docproof.streaming import jobs, tokens


def rows(df):
    return sorted(map(str, df.collect()))


def test_process_stream_equals_batch_and_survives_a_restart(spark, small, tmp_path):
    source = bindings.invoices(spark, small).select(*jobs.INPUT_SCHEMA.fieldNames())
    halves = [source.filter(F.col("doc_id") % 2 == i) for i in (0, 1)]
    base = str(tmp_path)
    for half in halves:
        half.write.mode("append").parquet(f"{base}/in")
        arrivals = jobs.read_arrivals(spark, f"{base}/in", jobs.INPUT_SCHEMA)
        jobs.process_stream(arrivals, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    shown = ("id", "status", "confidence", "json_output")
    got = spark.read.parquet(f"{base}/out/documents").select(*shown)
    assert rows(got) == rows(_stored(spark, small).select(*shown))
    for name in ("extractions", "audit_logs"):
        assert spark.read.parquet(f"{base}/out/{name}").count() == got.count()


def test_a_killed_batch_is_invisible_and_a_replay_changes_nothing(spark, small, tmp_path, monkeypatch):
    source = bindings.invoices(spark, small).select(*jobs.INPUT_SCHEMA.fieldNames())
    first, second = (source.filter(F.col("doc_id") % 2 == i) for i in (0, 1))
    out, tables = str(tmp_path), ("documents", "extractions", "audit_logs")
    counts = lambda: [jobs.read_committed(spark, out, t).count() for t in tables]
    assert jobs.commits(spark, out).count() == 0
    jobs.write_batch(first, 0, out)
    n = first.count()
    assert counts() == [n] * 3
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "audit_rows", lambda stored: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.write_batch(second, 1, out)
    assert spark.read.parquet(f"{out}/documents").count() == source.count()  # written, but not to be seen
    assert counts() == [n] * 3
    jobs.write_batch(second, 1, out)
    assert counts() == [source.count()] * 3
    files = lambda: sorted((str(f), f.stat().st_mtime_ns) for f in tmp_path.rglob("*.parquet"))
    before = files()
    jobs.write_batch(second, 1, out)
    assert files() == before
    found = {r["batch_id"]: r["documents"] for r in jobs.commits(spark, out).collect()}
    assert found == {0: n, 1: source.count() - n}


def drain(spark, stream, path):
    jobs.run_to_table(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_dedupe_stream_forgets_after_the_delay(spark, tmp_path):
    at = lambda minutes: dtm.datetime(2026, 1, 1, tzinfo=dtm.timezone.utc) + dtm.timedelta(minutes=minutes)
    schema = "name string, size long, last_modified long, ts timestamp"
    batches = ([("a", 1, 1, at(0)), ("a", 1, 1, at(5)), ("b", 1, 1, at(6))], [("c", 1, 1, at(600))], [("a", 1, 1, at(601)), ("d", 1, 1, at(1))])
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        out = drain(spark, jobs.dedupe_stream(stream, "60 minutes"), tmp_path)
    # The late repeat of "a" is new again; "d" is older than the watermark and dropped.
    assert sorted(r["name"] for r in out.collect()) == ["a", "a", "b", "c"]


def test_trend_stream_counts_all_days(spark, small, tmp_path):
    """Also over several batches, and the days that are still open at the end."""
    events = bindings.audit_logs(spark, small).select("id", "created_at")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.trend_stream(jobs.read_arrivals(spark, f"{tmp_path}/in", events.schema, files_per_batch=1), "60 days")
    jobs.trend_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    batch = {str(r["d"]): r["count"] for r in events.groupBy(F.col("created_at").cast("date").alias("d")).count().collect()}
    assert {str(r["label"]): r["value"] for r in jobs.read_trend(spark, f"{tmp_path}/out").collect()} == batch


def chunk(seq, content, done=False):
    reason = ',"done_reason":"stop","eval_count":7' if done else ""
    return f'{{"message":{{"content":"{content}"}},"done":{str(done).lower()}{reason}}}'


def test_token_stream_over_batches_with_gaps_repeats_and_abandoned_requests(spark, tmp_path):
    """Every row comes from the stream; a span is closed only when all its chunks are there."""
    line = lambda req, seq, *rest: (req, seq, chunk(seq, *rest))
    batches = (
        [line(1, 0, "a "), line(1, 1, "b "), line(2, 0, "lost "), line(3, 1, "late "), line(4, 0, "x"), line(5, 0, "p "), line(5, 1, "q "), line(5, 2, "r ")],
        [line(1, 1, "b "), line(1, 2, "c", True), line(3, 3, "", True), line(4, 2, "z", True), line(5, 3, "s "), line(5, 4, "", True)],
        [line(1, 0, "a "), line(3, 0, "not "), line(3, 2, "at all"), (2, 5, "broken")],
    )
    schema = "req_id long, seq long, line string"
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        tokens.spans_to_table(tokens.token_stream(stream, 4), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    spans = tokens.latest_spans(spark, f"{tmp_path}/out")
    state = {(r["req_id"], r["segment"]): (r["text"], r["closed"]) for r in spans.collect()}
    assert state == {
        (1, 0): ("a b c", True),  # closed in the second batch; the repeat of the third changes nothing
        (2, 0): ("lost ", False), (2, 1): ("", False),  # given up
        (3, 0): ("not late at all", True),  # closing record before the first chunk
        (4, 0): ("xz", False),  # a gap
        (5, 0): ("p q r s ", True), (5, 1): ("", True),  # a full span, and the one with the closing record
    }
    versions = {(r["req_id"], r["segment"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {(3, 0, 1), (3, 0, 2), (3, 0, 3)} <= versions
    everything = spark.createDataFrame([row for batch in batches for row in batch], schema).dropDuplicates(["req_id", "seq"])
    want = assemble_token_stream(everything, 4).filter("NOT (req_id = 2 AND segment = 1)")
    got = tokens.stream_texts(spans).filter("NOT (req_id = 2 AND segment = 1)")
    assert rows(got) == rows(want)


def test_token_stream_frees_what_was_given_up(spark, tmp_path):
    schema = "req_id long, seq long, line string"
    spark.createDataFrame([(1, 0, chunk(0, "a"))], schema).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    query = tokens.spans_to_table(tokens.token_stream(stream, 4, timeout_ms=500), f"{tmp_path}/out", f"{tmp_path}/checkpoint",
                                  {"processingTime": "500 milliseconds"})
    held = []
    try:
        for _ in range(60):
            time.sleep(0.5)
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            if held and max(held) > 0 and held[-1] == 0:
                break
    finally:
        query.stop()
    assert max(held) > 0 and held[-1] == 0
    assert [(r["text"], r["closed"]) for r in tokens.latest_spans(spark, f"{tmp_path}/out").collect()] == [("a", False)]


def test_token_stream_equals_batch_row_for_row(spark, small, tmp_path):
    """Also with requests that were given up or have a gap."""
    chunks = bindings.token_chunks(spark, small).filter(~((F.col("req_id") % 4 == 0) & (F.col("seq") % 9 == 5)))
    chunks.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_arrivals(spark, f"{tmp_path}/in", chunks.schema, files_per_batch=1)
    tokens.spans_to_table(tokens.token_stream(stream, 16), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    spans = tokens.latest_spans(spark, f"{tmp_path}/out")
    assert spans.filter("NOT closed").count() > 0
    assert sorted(map(tuple, tokens.stream_texts(spans).collect())) == sorted(map(tuple, assemble_token_stream(chunks, 16).collect()))
