"""SentencePiece encoding with offsets into the original bytes, and decoding.

The model file is read directly. A text is normalised by the longest-prefix rules of the compiled character map; for
every character of the result the byte of the source it came from is recorded. The normalised text is cut where no
piece can reach across, each distinct cut is merged once by the byte-pair rules, and every piece is projected through
the recorded alignment to the bytes of the original text it stands for.

Covers byte-pair models without user-defined or unused pieces; others are refused. Edge cases: a null text counts as
empty, which has only begin and end ids; an unknown character falls back to its bytes where the model has them, else
to the unknown id; texts of any length are encoded whole (long runs by a heap); equal texts give equal rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.chunks import ChunkCache
from docproof.llm.common import map_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
SHORT = 48  # symbols; longer runs are merged one by one with a heap
TOGETHER = 8192  # short runs merged at once
NEVER = np.iinfo(np.int32).max
CACHED = 100_000  # runs kept by a worker, in each of two generations
SLICE = 1 << 20  # bytes of text encoded together


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message; fixed and delimited values as bytes."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Rules of a compiled map: source text -> replacement, read from its double-array trie."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, str] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self._walk(np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :])
        self.longest = max(map(len, self.rules), default=0)
        self.first = {r[0] for r in self.rules}

    def _walk(self, units: list[int], texts: bytes) -> None:
        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        open_nodes = [(offset(units[0]), b"")]
        while open_nodes:
            base, prefix = open_nodes.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at >= len(units) or units[at] & 0x800000FF != byte:
                    continue
                source, below = prefix + bytes([byte]), at ^ offset(units[at])
                if units[at] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    self.rules[source.decode()] = texts[start : texts.index(b"\0", start)].decode()
                open_nodes.append((below, source))

    def prefix(self, text: str, at: int) -> tuple[str, int]:
        """Replacement of the longest rule that begins at ``at`` (else the character itself), and its length."""
        if text[at] in self.first:
            for size in range(min(self.longest, len(text) - at), 0, -1):
                found = self.rules.get(text[at : at + size])
                if found is not None:
                    return found, size
        return text[at], 1


def _utf8_sizes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)


class PieceModel:
    def __init__(self, model: bytes):
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                self._piece({k: v for k, v in _fields(value)})
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != BPE or {USER_DEFINED, UNUSED} & set(self.kinds) or trainer.get(24, 0):
            raise ValueError("only byte-pair models without user-defined or unused pieces are covered")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ")
        self.dummy, self.trims, self.escapes = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.map = CharacterMap(rules.get(2, b""))
        self.begin_id, self.end_id = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_id = self.kinds.index(UNKNOWN)
        self.space = SPACE if self.escapes else " "
        self.cutter = self._cutter()
        self.plain = not self.map.rules and not self.trims
        self.cache = ChunkCache(self._encode_chunks, CACHED)
        self._pair_table()
        self.is_byte = np.array(self.kinds) == BYTE
        self.tails = np.array([k == BYTE and 0x80 <= p[0] < 0xC0 for p, k in zip(self.pieces, self.kinds)])
        spaces = SPACE.encode()
        self.shown = [
            b"\xff" if k == CONTROL else self.unknown_text if k == UNKNOWN else p if k == BYTE else p.replace(spaces, b" ")
            for p, k in zip(self.pieces, self.kinds)
        ]

    def _piece(self, fields: dict) -> None:
        text, kind = fields.get(1, b"").decode(), fields.get(3, NORMAL)
        number = len(self.pieces)
        if kind == BYTE:
            value = int(text[3:5], 16)
            self.byte_ids[value] = number
            self.pieces.append(bytes([value]))
        else:
            self.pieces.append(text.encode())
        self.kinds.append(kind)
        if kind == NORMAL:
            self.ids[text] = number
            self.scores[text] = struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0

    def _cutter(self) -> re.Pattern:
        """Matches runs that merges cannot leave: a space opens a run unless pieces hold spaces inside, and characters
        found in no longer piece stand alone."""
        inside = set().union(*(p for p in self.ids if len(p) > 1), {self.space})
        letters = "".join(map(re.escape, sorted(inside - {self.space})))
        space = re.escape(self.space)
        if any(self.space in p.lstrip(self.space) for p in self.ids) or not letters:
            return re.compile(f"[{letters}{space}]+|.", re.S)
        return re.compile(f"{space}*[{letters}]+|{space}+|.", re.S)

    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and for each of its characters and its end the byte of the source.

        None stands for the plain alignment: every character is kept, after the leading space if there is one.
        """
        if self.plain:
            if not text:
                return "", None
            return (self.space if self.dummy else "") + (text.replace(" ", SPACE) if self.escapes else text), None
        places = np.concatenate([[0], np.cumsum(_utf8_sizes(text))]).tolist() if text else [0]
        out, source, at = [], [], 0
        if self.trims:
            while at < len(text):
                found, size = self.map.prefix(text, at)
                if found != " ":
                    break
                at += size
        if at == len(text):
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out.append(self.space)
            source.append(places[at])
        after_space = self.trims
        while at < len(text):
            found, size = self.map.prefix(text, at)
            if after_space:
                found = found.lstrip(" ")
            if found:
                out += found.replace(" ", SPACE) if self.escapes else found
                source += [places[at]] * len(found)
                after_space = found.endswith(" ")
            at += size
            after_space = after_space and self.trims
        end = places[-1]
        if self.trims:
            while out and out[-1] == self.space:
                out.pop()
                end = source.pop()
        return "".join(out), np.array([*source, end], np.int64)

    def _merge(self, run: str) -> list[str]:
        """Join neighbours by the best score, leftmost first, until no neighbours form a piece."""
        parts = list(run)
        if len(parts) > SHORT:
            return self._merge_long(parts)
        score = self.scores.get
        low = float("-inf")
        gains = [score(a + b, low) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == low:
                break
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            gains.pop(i)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], low)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], low)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                joined = parts[left] + parts[right]
                found = self.scores.get(joined)
                if found is not None:
                    heapq.heappush(heap, (-found, left, right, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if not parts[left] or after[left] != right or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p]

    def _encode_chunks(self, runs: list[str]) -> list[bytes]:
        """Ids of the pieces of each run, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(runs)
        order = sorted((i for i, r in enumerate(runs) if len(r) <= SHORT), key=lambda i: len(runs[i]))
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            for i, ids in zip(some, self._merge_together([runs[i] for i in some])):
                out[i] = ids
        return [self._encode_run(r) if o is None else o for r, o in zip(runs, out)]

    def _encode_run(self, run: str) -> bytes:
        ids: list[int] = []
        for part in self._merge(run):
            found = self.ids.get(part)
            if found is not None:
                ids.append(found)
            elif self.byte_fallback:
                ids += [self.byte_ids[b] for b in part.encode()]
            else:
                ids.append(self.unknown_id)
        return np.array(ids, "<u4").tobytes()

    def _pair_table(self) -> None:
        """For every two pieces that form a third: key, rank of its score, and the third."""
        v = len(self.pieces)
        ranks = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = [
            (self.ids[p[:k]] * v + self.ids[p[k:]], ranks[self.scores[p]], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        ]
        rows.sort()
        keys, self.pair_ranks, self.pair_ids = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ranks = np.append(self.pair_ranks, NEVER).astype(np.int32)
        self.pair_ids = np.append(self.pair_ids, 0).astype(np.int32)
        singles = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.letters = np.full(0x110000, -1, np.int32)
        self.letters[list(singles)] = list(singles.values())
        self.lengths = np.array([len(p.decode()) if k == NORMAL else 1 for p, k in zip(self.pieces, self.kinds)], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER where nothing forms) and id of left + right; a negative id forms nothing."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER), self.pair_ids[at]

    def _merge_together(self, runs: list[str]) -> list[bytes | None]:
        """The merges of many short runs at once, each in its own order: a row of symbols for each run, with links to
        the neighbours that are left. None for a run with characters that are no pieces."""
        sizes = np.array([len(r) for r in runs])
        n, width = len(runs), int(sizes.max())
        points = np.frombuffer("".join(runs).encode("utf-32-le"), "<u4")
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[np.arange(width + 1) < sizes[:, None]] = self.letters[points]
        covered = (symbols >= 0).sum(axis=1) == sizes
        ranks, ids = self._pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        ranks, ids = ranks.reshape(n, width), ids.reshape(n, width)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while len(rows):
            best = ranks[rows].argmin(axis=1)
            go = ranks[rows, best] < NEVER
            rows, i = rows[go], best[go]
            if not len(rows):
                break
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i] = ids[rows, i]
            symbols[rows, j] = -1
            after[rows, i] = k
            before[rows, np.minimum(k, width)] = i
            ranks[rows, np.minimum(j, width - 1)] = NEVER
            ranks[rows, i], ids[rows, i] = self._pairs(symbols[rows, i], symbols[rows, np.minimum(k, width)])
            h = before[rows, i]
            has = h >= 0
            r, h = rows[has], h[has]
            ranks[r, h], ids[r, h] = self._pairs(symbols[r, h], symbols[r, i[has]])
        left = symbols >= 0
        ends = np.cumsum(left.sum(axis=1)) * 4
        data = symbols[left].astype("<u4").tobytes()
        starts = [0, *ends[:-1].tolist()]
        return [data[a:b] if c else None for a, b, c in zip(starts, ends.tolist(), covered.tolist())]

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Characters each piece stands for; of the bytes of one character the last has it."""
        sizes = self.lengths[ids]
        if self.byte_fallback:
            tail = np.append(self.tails[ids[1:]], False)
            sizes = np.where(self.is_byte[ids] & tail, 0, sizes)
        return sizes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids with begin and end, and their (start, stop) bytes in the original text, for each text."""
        normal = [self.normalize(t) for t in texts]
        runs = [self.cutter.findall(n) for n, _ in normal]
        known = self.cache.values(runs)
        out = []
        for text, (shown, source), parts in zip(texts, normal, runs):
            ids = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")
            sizes = self._sizes(ids)
            if not self.byte_fallback and len(ids):
                ids, sizes = self._join_unknown(ids, sizes)
            if source is None:
                lead = len(shown) - len(text)
                if text.isascii():
                    source = np.maximum(np.arange(len(shown) + 1) - lead, 0)
                else:
                    source = np.concatenate([np.zeros(lead + 1, np.int64), np.cumsum(_utf8_sizes(text))])
            stops = np.cumsum(sizes, dtype=np.int64)
            last = source[-1]
            full = np.empty(len(ids) + 2, "<u4")
            full[0], full[1:-1], full[-1] = self.begin_id, ids, self.end_id
            spans = np.zeros((len(full), 2), "<i8")
            spans[1:-1, 0], spans[1:-1, 1], spans[-1] = source[stops - sizes], source[stops], last
            out.append((full, spans))
        return out

    def _join_unknown(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring unknown characters are one piece."""
        unknown = ids == self.unknown_id
        opens = ~(unknown & np.concatenate([[False], unknown[:-1]]))
        return ids[opens], np.add.reduceat(sizes, np.flatnonzero(opens))

    def decode(self, ids) -> str:
        """Text of ids: control ids are silent, the leading space goes, bytes that are no UTF-8 become U+FFFD."""
        kinds = self.kinds
        rest = list(ids)
        while rest and kinds[rest[-1]] == CONTROL:
            rest.pop()
        at = 0
        while at < len(rest) and kinds[rest[at]] == CONTROL:
            at += 1
        # A control id further in ends a run of bytes; it shows as no UTF-8 and so takes the slower way.
        body = b"".join(map(self.shown.__getitem__, rest[at:]))
        if at < len(rest) and kinds[rest[at]] == NORMAL and (self.dummy or self.trims):
            body = body.lstrip(b" ") if self.trims and self.pieces[rest[at]].strip(SPACE.encode()) == b"" else (
                body[1:] if body.startswith(b" ") else body)
        try:
            return body.decode()
        except UnicodeDecodeError:
            return self._decode_runs(rest)

    def _decode_runs(self, ids: list[int]) -> str:
        """As decode, where some bytes make no character: every run of byte ids is read by itself."""
        out: list[str] = []
        run = bytearray()
        start, seen = True, False
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.pieces[i]
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i is None:
                break
            if seen or any(out):
                start = False
            text, seen = "" if self.kinds[i] == CONTROL else self.shown[i].decode(), False
            if start and self.kinds[i] == NORMAL and (self.dummy or self.trims) and text.startswith(" "):
                text, seen = text[1:], not self.trims
            out.append(text)
        return "".join(out)


def _lenient(data: bytes) -> str:
    """UTF-8 read character by character; every byte that opens none becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def load(model: bytes) -> PieceModel:
    """The model and its cache, for as long as a task runs: a worker keeps nothing of them for other work."""
    return PieceModel(model)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, starts, stops, decoded) of every row: piece ids, the bytes of the original text each one
    stands for, and the text that the ids spell."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, decoded = _encoded(batch, shared.value)
        counts = np.array([len(ids) for ids, _ in found], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        ids = np.concatenate([ids for ids, _ in found]).astype(np.int32)
        spans = np.concatenate([s for _, s in found])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v))) for v in (ids, spans[:, 0], spans[:, 1])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *lists, pa.array(decoded, pa.string())],
                                          names=["doc_id", "n_tokens", "ids", "starts", "stops", "decoded"])

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids array<int>, starts array<long>, stops array<long>, decoded string"
    return map_text(rows, run, schema, limit=SLICE)


def digest_documents(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Count and digests of what encode_documents gives for every row; spans as little-endian 64-bit (start, stop)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, decoded = _encoded(batch, shared.value)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(ids) for ids, _ in found], pa.int64()),
                pa.array([_digest(ids.tobytes()) for ids, _ in found], pa.string()),
                pa.array([_digest(t.encode()) for t in decoded], pa.string()),
                pa.array([_digest(spans.tobytes()) for _, spans in found], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, run, SCHEMA, limit=SLICE)


def _encoded(batch: pa.RecordBatch, data: bytes):
    model = load(data)
    found = model.encode([t or "" for t in batch.column("text").to_pylist()])
    return found, [model.decode(ids.tolist()) for ids, _ in found]
