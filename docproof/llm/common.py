"""Helpers the operators share: tables, shared storage, Arrow batches, groups that stay bounded."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
CONTRACTED_LINKS = 1 << 17
BROADCAST_ROWS = 100_000  # of a few numbers each


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return f"file://{tempfile.mkdtemp(prefix='docproof-llm-')}"
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to shared storage and read it back: the work is done once and outlives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(f"{path}/t")
    found = df.sparkSession.read.schema(df.schema).parquet(f"{path}/t")
    found.staged_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote; the caller reads neither them nor anything not yet computed from them again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def worker_cached(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the Python worker across its tasks; the last value of each kind (``key[0]``) stays."""
    held = vars(sys.modules.setdefault("docproof_worker_cache", ModuleType("docproof_worker_cache")))
    if held.get(key[0], (None, None))[0] != key:
        held[key[0]] = (key, make())
    return held[key[0]][1]


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes of text; one long text makes a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, column: str = "text",
             limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to slices of a table, each of bounded text size."""

    def run(batches):
        for part in slices(batches, column, limit):
            yield fn(part)

    return df.mapInArrow(run, schema)


def keep_where(docs: DataFrame, accept: Callable[[list[str]], np.ndarray], text: str = "text",
               limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is accepted; null counts as empty."""

    def run(batches):
        for part in slices(batches, text, limit):
            yield part.filter(pa.array(accept([t or "" for t in part.column(text).to_pylist()])))

    return docs.mapInArrow(run, docs.schema)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table | None], schema: str,
               rows: int = 4096) -> DataFrame:
    """Bring the rows of each key together and apply ``fn`` to tables of whole groups.

    A table holds one large group or many small ones. Callers keep each group bounded by its key.
    """
    keys = list(keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def done(parts):
            out = fn(pa.Table.from_batches(parts))
            return [] if out is None else out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.zeros(whole.num_rows - 1, bool)
            for k in keys:
                values = whole.column(k).combine_chunks()
                last |= pc.not_equal(values[:-1], values[1:]).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield from done(whole.slice(0, cut).to_batches())
            held = whole.slice(cut).to_batches()
            count = whole.num_rows - cut
        if held:
            yield from done(held)

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(spread, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def labelled_sample(rows: DataFrame, text_id: str, text: str, label: str, per_label: int, chars: int) -> dict[str, list[str]]:
    """Texts of each label for a classifier: at most ``chars`` characters of it reach the driver.

    From each of ``per_label`` hash classes of the ids the row with the smallest hash is drawn, whatever the size of the
    label; of rows that share an id the smallest text. Rows without text or label are passed over.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    drawn = F.xxhash64(F.col(text_id).cast("string"), F.lit("sample"))
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), drawn.alias("drawn"))
    slot = F.pmod("drawn", F.lit(per_label)).alias("slot")
    chosen = staged(rows.groupBy("label", slot).agg(F.min("drawn").alias("drawn")))
    # With a known, small number of draws the texts need not move; more labels than that go by a shuffle.
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sample = rows.select("label", F.substring("text", 1, chars).alias("text"), "drawn", slot)
    sample = sample.join(chosen, ["label", "slot", "drawn"], "left_semi")
    sample = sample.groupBy("label", "drawn").agg(F.min("text").alias("text")).orderBy("label", "drawn")
    texts: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for row in sample.toLocalIterator():
        name = row["label"]
        if held.get(name, 0) < chars:
            texts.setdefault(name, []).append(row["text"][: chars - held.get(name, 0)])
            held[name] = held.get(name, 0) + len(texts[name][-1])
    return texts


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each group of a table sorted by ``keys``."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        values = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(values[:-1], values[1:]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def contracted(edges: DataFrame, limit: int = CONTRACTED_LINKS) -> DataFrame:
    """Undirected links (a, b) between longs, fewer but with the same components and the same nodes.

    Each task replaces some ``limit`` of its links at a time by stars, from every node to the smallest one it reaches by
    them. That leaves ``components`` few rounds. Links of a node to itself go.
    """

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(parts)
        nodes, at = np.unique(np.concatenate([links.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        forest = Forest(len(nodes))
        for a, b in zip(at[: links.num_rows].tolist(), at[links.num_rows :].tolist()):
            forest.join(a, b)
        roots = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
        own = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                yield stars(held)
                held, count = [], 0
        if count:
            yield stars(held)

    pairs = edges.select("a", "b").filter("a != b")
    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b) between longs: (node, root), root the smallest node.

    Alternates hooking every neighbour to the smallest one above and below it; what is left are stars. A round costs
    two aggregations and two joins over the links and is written to shared storage. Every node comes once.
    """
    links = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    )
    fingerprint = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    known = links.agg(*fingerprint).first()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = staged(small.filter("u != v").distinct())
        before, known = known, after.agg(*fingerprint).first()
        if before == known:
            discard(after)
            break
        discard(links)
        links = after
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over row numbers of one bounded group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
