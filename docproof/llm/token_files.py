"""Token ids in Arrow files of equal-length sequences, written and read back by Spark tasks.

Documents are ranged by id. A task writes its range as two Arrow IPC files: sequences, as batches of fixed-size lists
(``ids`` and ``mask``), and an index (doc_id, start, n_tokens; start within the file). Documents run on from one
sequence into the next; only the last sequence of a file is padded, and the mask says where. A sequence is found by
its number without reading the others and is used in place.

A task's files have names of their own and count once the manifest, written by Spark, names them; so a repeated or
lost task leaves no doubt about what belongs to the result.

Texts are encoded by the tokenizers library. For byte-level tokenizers, whose splitting never looks across a chunk as
cut here, distinct chunks are encoded once and joined; texts with special tokens, and any other tokenizer, are encoded
whole.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; repeated rows are written as often as
they come; equal ids lie side by side; texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.chunks import ChunkCache
from docproof.llm.common import shared_folder, slices, staged, worker_cached

SEQUENCE = 2048
BATCH_SEQUENCES = 256
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,!?;:*&$#%|]"
# A run of letters up to a sign or space and a run of signs up to a letter or space end where the library's own
# splitting ends, and so do non-space runs and the parts of white space.
CHUNK = re.compile(
    f" ?{LETTERS}+(?={SIGNS}|{SPACE}|\\Z)| ?{SIGNS}+(?={LETTERS}|{SPACE}|\\Z)| ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+"
)
TOGETHER = 500
SLICE = 4 << 20  # bytes of text encoded together


def open_storage(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def storage_uri(spark, path: str) -> str:
    """The full address of a path, so that tasks on other machines mean the same place."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


class TextEncoder:
    """Texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model)
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.chunked = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
            and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        )
        self.chunks = ChunkCache(self._apart)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _apart(self, chunks: list[str]) -> list[bytes]:
        """Each chunk by itself; many that hold no line end are encoded as the lines of one text, which costs less."""
        lines = [c for c in chunks if "\n" not in c and not c.isspace()] if len(self.newline) == 1 else []
        known: dict[str, bytes] = {}
        for at in range(0, len(lines), TOGETHER):
            some = lines[at : at + TOGETHER]
            ids = np.frombuffer(self._whole(["\n".join(some)])[0], "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.newline[0]).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:
                data = ids.tobytes()
                known.update((c, data[4 * a + 4 : 4 * b]) for c, a, b in zip(some, cuts, cuts[1:]))
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, self._whole(rest)))
        return [known[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.chunked and not any(s in t for s in self.special) for t in texts]
        parts = [CHUNK.findall(t) if p else [] for t, p in zip(texts, plain)]
        known = self.chunks.values(parts)
        join = b"".join
        return [join(map(known.__getitem__, c)) if p else self._whole([t])[0] for t, c, p in zip(texts, parts, plain)]


def sequence_schema(width: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])


class SequenceWriter:
    """Appends ids to a file of sequences; holds one batch at most."""

    def __init__(self, sink, width: int, kind: pa.DataType):
        self.width, self.kind, self.schema = width, kind, sequence_schema(width, kind)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def _batch(self, ids: np.ndarray) -> None:
        padded = np.zeros(-(-len(ids) // self.width) * self.width, ids.dtype)
        padded[: len(ids)] = ids
        mask = pa.array(np.arange(len(padded)) < len(ids))
        lists = [pa.FixedSizeListArray.from_arrays(v, self.width) for v in (pa.array(padded, self.kind), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        full = self.width * BATCH_SEQUENCES
        if self.count >= full:
            joined = np.concatenate(self.held)
            for at in range(0, len(joined) - full + 1, full):
                self._batch(joined[at : at + full])
            rest = joined[len(joined) - len(joined) % full :]
            self.held, self.count = [rest.copy()], len(rest)

    def close(self) -> None:
        if self.count:
            self._batch(np.concatenate(self.held))
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one file; local files are mapped, arrays are views of the file's memory."""

    def __init__(self, uri: str):
        store, path = open_storage(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.width = self.reader.schema.field("ids").type.list_size
        self.number, self.batch = -1, None

    def _batch(self, number: int) -> pa.RecordBatch:
        if number != self.number:
            self.number, self.batch = number, self.reader.get_batch(number)
        return self.batch

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch = self._batch(number // BATCH_SEQUENCES)
        row = number % BATCH_SEQUENCES
        ids, mask = batch.column("ids")[row].values, batch.column("mask")[row].values
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in runs that lie together in the file."""
        full = self.width * BATCH_SEQUENCES
        while count > 0:
            flat = self._batch(start // full).column("ids").flatten().to_numpy(zero_copy_only=True)
            run = flat[start % full :][:count]
            if not len(run):
                raise EOFError("the file ends before the ids do")
            yield run
            start, count = start + len(run), count - len(run)


MANIFEST = "part int, sequences string, docs string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, model: str, end_id: int, folder: str, sequence: int = SEQUENCE, vocabulary: int | None = None,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in the order of their ids; the manifest, one row a file pair, in the order of ``part``."""
    spark = docs.sparkSession
    place = storage_uri(spark, folder)
    shared = spark.sparkContext.broadcast(model)
    small = vocabulary is not None and max(vocabulary, end_id + 1) <= 1 << 16
    kind, dtype = (pa.uint16(), "<u2") if small else (pa.uint32(), "<u4")

    def write(batches):
        from pyspark import TaskContext

        rows = slices((b for b in batches if b.num_rows), "text", SLICE)
        first = next(rows, None)
        if first is None:
            return
        encoder = worker_cached(("text encoder", zlib.crc32(shared.value.encode())), lambda: TextEncoder(shared.value))
        store, path = open_storage(place)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        tail = array("I", [end_id]).tobytes()
        n_docs = at = 0
        with store.open_output_stream(f"{path}/{name}.ids.arrow") as a, store.open_output_stream(f"{path}/{name}.docs.arrow") as b:
            out = SequenceWriter(a, sequence, kind)
            index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
            index = pa.ipc.new_file(b, index_schema)
            while first is not None:
                texts = [t or "" for t in first.column("text").to_pylist()]
                encoded = encoder.encode(texts)
                sizes = np.array([len(ids) for ids in encoded], np.int64) // 4 + 1
                out.add(np.frombuffer(tail.join([*encoded, b""]), "<u4").astype(dtype))
                starts = at + np.cumsum(sizes) - sizes
                columns = [first.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(sizes)]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=index_schema))
                n_docs, at = n_docs + len(texts), at + int(sizes.sum())
                first = next(rows, None)
            out.close()
            index.close()
        yield pa.RecordBatch.from_pylist([{
            "part": part, "sequences": f"{place}/{name}.ids.arrow", "docs": f"{place}/{name}.docs.arrow",
            "n_docs": n_docs, "n_tokens": at,
        }], schema=pa.schema([("part", pa.int32()), ("sequences", pa.string()), ("docs", pa.string()),
                              ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The row's own number keeps a much repeated id from filling one range.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(spread, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return staged(ranged.mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts all ids before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "sequences", "docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shift"))

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                sequences = SequenceFile(file["sequences"])
                store, path = open_storage(file["docs"])
                with store.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        sums = []
                        for start, count in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            crc = 0
                            for run in sequences.tokens(start, count):
                                crc = zlib.crc32(run.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        start = pa.array(docs.column("start").to_numpy() + file["shift"])
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.repartition(spread, "part")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, model: str, end_id: int, sequence: int = SEQUENCE, vocabulary: int | None = None,
                folder: str | None = None) -> DataFrame:
    """Write ``docs`` to files in ``folder`` (default: a new one in shared storage) and describe what the files hold."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens"
    return read_tokens(write_tokens(docs, model, end_id, folder, sequence, vocabulary))
