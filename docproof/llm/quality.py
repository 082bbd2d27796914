"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed for all texts of a batch at once: shares of character classes and signs, word lengths, capitals,
repeated neighbours, distinct words, lines. Trees are grown on binned statistics of a bounded sample of labelled rows
(``sample_rows``) and flattened into arrays; scoring walks all documents through all trees level by level.

Edge cases: a null or empty text has all statistics zero and is scored like any other; labels that are null teach
nothing, of several labels of one id the mean counts; without labelled rows the score is 0.5, with labels of one kind
their smoothed share; repeated rows and long texts are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from docproof.llm.common import BROADCAST_ROWS, keep_where, map_text, worker_cached

SAMPLE_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
L2 = 1.0
THRESHOLD = 0.7
SLICE = 2 << 20

SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, CAPITAL, DIGIT, BLANK, NEWLINE, OTHER = range(6)
CLASSES = 6 + len(SIGNS)


def _make_classes() -> np.ndarray:
    """Class of every character."""
    kinds = np.full(0x110000, OTHER, np.int8)
    for c in range(0x3000):
        s = chr(c)
        kinds[c] = CAPITAL if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isdigit() else BLANK if s.isspace() else OTHER
    for c in range(0x3000, 0x110000):
        if chr(c).isalpha():
            kinds[c] = LOWER
    kinds[ord("\n")] = NEWLINE
    kinds[[ord(s) for s in SIGNS]] = np.arange(6, CLASSES)
    return kinds


def _classes() -> np.ndarray:
    return worker_cached(("character classes",), _make_classes)


def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(n), sizes)
    kinds = _classes()[points]
    counts = np.bincount(owner * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    chars = np.maximum(sizes, 1)[:, None]

    solid = (kinds != BLANK) & (kinds != NEWLINE)
    opens = solid.copy()
    opens[1:] &= ~(solid[:-1] & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(opens)
    inside = np.flatnonzero(solid)
    word = np.cumsum(opens)[inside] - 1
    n_words = len(starts)
    lengths = np.bincount(word, minlength=n_words)
    of = owner[starts]
    words = np.bincount(of, minlength=n)
    safe = np.maximum(words, 1)

    def per_word(values) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n) / safe

    place = inside - starts[word] if n_words else inside
    mixed = (points[inside].astype(np.uint64) + np.uint64(1)) * _weights()[place & 63]
    hashes = np.add.reduceat(mixed, np.searchsorted(word, np.arange(n_words))) if n_words else np.zeros(0, np.uint64)
    same = np.zeros(n_words)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    if n_words:
        order = np.lexsort((hashes, of))
        new = np.ones(n_words)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order], weights=new, minlength=n) / safe
    else:
        distinct = np.zeros(n)

    def in_words(mask) -> np.ndarray:
        return np.bincount(word[mask[inside]], minlength=n_words) if n_words else np.zeros(0)

    capital, lower, signs = in_words(kinds == CAPITAL), in_words(kinds == LOWER), in_words(kinds >= 6)
    digits = in_words(kinds == DIGIT)
    letters = capital + lower
    mean = per_word(lengths)
    spread = np.sqrt(np.maximum(per_word(lengths.astype(float) ** 2) - mean**2, 0))
    lines = counts[:, NEWLINE] + 1
    extra = [
        np.log1p(sizes), np.log1p(words), np.log1p(lines), words / lines, mean, spread, distinct, per_word(same),
        per_word((capital > 1) & (lower == 0)), per_word((capital == 1) & (lower > 0)), per_word(signs > 0),
        per_word(signs > 1), per_word(digits > 0), per_word(letters == 0), per_word(lengths == 1), per_word(lengths > 12),
        per_word(lengths > 24), counts[:, 6:].sum(axis=1) / chars[:, 0], distinct * np.sqrt(words),
    ]
    return np.column_stack([counts / chars, *extra])


class Trees:
    """Complete trees of one depth as arrays: feature and threshold of inner nodes, value of leaves."""

    def __init__(self, depth: int, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray, base: float):
        self.depth, self.features, self.thresholds, self.values, self.base = depth, features, thresholds, values, base

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for log loss, level by level from histograms of gradients over binned columns."""
    n, columns = x.shape if len(x) else (0, 1)
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        none = np.zeros((0, inner))
        return Trees(depth, none.astype(np.int64), none, np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(columns)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    edges = np.full((columns, bins), np.inf)
    for f, c in enumerate(cuts):
        edges[f, : len(c)] = c
    flat = (binned + np.arange(columns) * bins).astype(np.int64)
    total = np.full(n, base)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slots = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            hist = [np.bincount(slots, np.repeat(v, columns), width * columns * bins).reshape(width, columns, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(v, axis=2) for v in hist)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < 1) | (right_h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(useful, best // bins, 0)
            threshold[first : first + width] = np.where(useful, edges[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        total += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(depth, *(np.array(v) for v in zip(*grown)), base)


def _statistics_of(rows: DataFrame, text: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics([t or "" for t in batch.column(text).to_pylist()])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "x"])

    return map_text(rows, run, "label double, x array<double>", text)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Grow trees on at most ``sample_rows`` labelled ids, those whose hash is smallest."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    drawn = known.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # An id that comes more than once teaches its smallest text only, so that the sample stays bounded.
    bounded = F.broadcast(drawn) if sample_rows <= BROADCAST_ROWS else drawn
    rows = texts.join(bounded, "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    sample = _statistics_of(rows.select("label", "text"), "text").toArrow()
    x = np.array(sample.column("x").combine_chunks().flatten()) if sample.num_rows else np.zeros(0)
    x = x.reshape(sample.num_rows, -1) if sample.num_rows else np.zeros((0, 1))
    y = sample.column("label").to_numpy()
    order = np.lexsort((*x.T, y)) if len(x) else np.zeros(0, np.int64)  # the order of arrival must not matter
    return grow(x[order], (y[order] >= 0.5).astype(float))


def predict(docs: DataFrame, model: Trees, keep: list[Column] | None = None, text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of every row with score and predicted; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(keep or []), F.col(text).alias("__text"))
    kept = rows.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.predict(statistics([t or "" for t in batch.column("__text").to_pylist()]))
        columns = [*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return map_text(rows, run, schema, "__text", SLICE)


def accepted(docs: DataFrame, model: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``; the others go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, lambda texts: shared.value.predict(statistics(texts)) >= threshold, text, SLICE)
