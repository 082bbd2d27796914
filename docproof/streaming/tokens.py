"""Token streams assembled as they arrive.

Chunks are grouped by request and span of sequence numbers, so a very long answer spreads over many groups and each
group's state is bounded by the span. A span that a batch touches is emitted as it stands, with a version and whether it
is ``closed``: full, or complete up to its closing record. So open spans, of requests with a gap or given up, come from
the stream itself; ``latest_spans`` reads the last state of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docproof.operators.assembly import CHUNKS_PER_SEGMENT, finish_spans, parse_chunks

OUTPUT = "req_id long, segment long, text string, n_chunks long, eval_count long, done_reason string, closed boolean, version long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _collector(timeout_ms: int | None) -> StatefulProcessor:
    """The processor as a local class, so that executors need no copy of this package."""

    class Spans(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # With a timeout a span's state also ends by itself, should its timer be lost.
            ttl = None if timeout_ms is None else 2 * timeout_ms
            self.pieces = handle.getListState("pieces", "seq long, content string", ttl)
            self.facts = handle.getValueState("facts", "version long, closing_seq long, eval_count long, done_reason string", ttl)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            version, closing_seq, eval_count, reason = self.facts.get() if self.facts.exists() else (0, -1, 0, None)
            pieces = dict(self.pieces.get()) if self.pieces.exists() else {}
            for batch in rows:
                # A repeated chunk of a retried producer overwrites itself.
                pieces.update(zip(batch["seq"].tolist(), batch["content"].tolist()))
                closing = batch[batch["done"]]
                if len(closing):
                    last = closing.loc[closing["seq"].idxmax()]
                    closing_seq, eval_count, reason = int(last["seq"]), int(last["eval_count"]), str(last["done_reason"])
            ordered = sorted(pieces.items())
            _, segment, span = key
            # Chunks may arrive in any order: the closing record says how many there are, it does not end the wait for them.
            wanted = span if reason is None else closing_seq - segment * span + 1
            closed = sum(1 for s, _ in ordered if reason is None or s <= closing_seq) >= wanted
            if timeout_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if closed:
                self._forget()
            else:
                self.pieces.put(ordered)
                self.facts.update((version + 1, closing_seq, eval_count, reason))
                if timeout_ms is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + timeout_ms)
            yield pd.DataFrame(
                {
                    "req_id": [key[0]],
                    "segment": [segment],
                    "text": ["".join(c for _, c in ordered)],
                    "n_chunks": [sum(1 for _, c in ordered if c)],
                    "eval_count": [eval_count],
                    "done_reason": [reason],
                    "closed": [closed],
                    "version": [version + 1],
                }
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # Its last state is emitted already; what a request that was given up holds is freed.
            self._forget()
            yield from ()

        def _forget(self) -> None:
            self.pieces.clear()
            self.facts.clear()

        def close(self) -> None:
            pass

    return Spans()


def token_stream(
    chunks: DataFrame, chunks_per_segment: int = CHUNKS_PER_SEGMENT, timeout_ms: int | None = None
) -> DataFrame:
    """The state of every span a batch touches: (req_id, segment, text, n_chunks, eval_count, done_reason, closed, version).

    With a timeout, for queries that run on, the state of a span that gets no chunk for that long is freed. A query that
    drains what has arrived and ends must not set one: its timers keep it running.
    """
    spans = parse_chunks(chunks, keep_broken=True).withColumns(
        {"segment": F.floor(F.col("seq") / chunks_per_segment), "span": F.lit(chunks_per_segment)}
    )
    mode = "None" if timeout_ms is None else "ProcessingTime"
    return spans.groupBy("req_id", "segment", "span").transformWithStateInPandas(_collector(timeout_ms), OUTPUT, "update", mode)


def spans_to_table(spans: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the spans of each batch in a folder named by it, so that a retry overwrites; drains what has arrived."""
    spark = spans.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        writer = spans.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, provider)


def latest_spans(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every span. A closed one stays, whatever repeated chunks came after it."""
    state = F.struct("text", "n_chunks", "eval_count", "done_reason", "closed")
    last = F.max_by(state, F.struct("closed", "batch_id")).alias("state")
    return spark.read.parquet(out).groupBy("req_id", "segment").agg(last).select("req_id", "segment", "state.*")


def stream_texts(spans: DataFrame) -> DataFrame:
    """``(req_id, segment, text, tokens, done_reason)`` of all requests, closed or not, as ``assemble_token_stream`` gives them."""
    seq = F.col("segment").alias("seq")
    closing = F.when(F.col("done_reason").isNotNull(), F.struct(seq, "eval_count", "done_reason"))
    return finish_spans(spans.select("req_id", "segment", "text", "n_chunks", closing.alias("closing")))
