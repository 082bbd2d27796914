"""Mixing sources to target weights with soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains, so a document counts in part
for each of them. Rates (how often a document is used) start at one and are fitted by projected gradient steps so that
the expected tokens of each domain, the sum of rate x tokens x posterior, meet the targets in the least-squares sense.
A step needs one distributed sum for each domain; its direction is the same few numbers for all documents, so the
history of steps gives every rate again, and no rate is ever collected or shuffled. A rate is made whole by its
fraction against a hash of the id: floor or one more copy.

The total is the smallest at which no domain has to shrink, with some headroom; with ``least=1`` every document is used
at least once and small domains are repeated, with ``least=0`` rates may fall to nothing.

The classifier (naive Bayes over hashed letter triples, its sharpness set on half the sample) is fitted on a bounded
sample of labelled rows; posteriors, tokens and sums cover all documents and whole texts.

Edge cases: a null or empty text has no tokens, the prior as posterior, and rate one (never below ``least``); labelled
domains without a target keep what they have, targets of unknown domains are passed over and the others rescaled; with
no labelled row or no token every rate is one; a null id is hashed as the empty text; repeated rows share one rate; an
empty table gives an empty result.
"""

from __future__ import annotations


from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docproof.llm.common import labelled_sample, map_text, staged

SAMPLE_PER_DOMAIN = 512
SAMPLE_CHARS = 400_000
FEATURES = 1 << 15
SHARPNESS = [2.0**k for k in range(0, 12)]
ROUNDS = 40
TOLERANCE = 1e-7
HEADROOM = 1.05


def _triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed triples of the bytes of each text (with a space before and after), and their number."""
    data = [b" " + t.encode("utf-8", "surrogatepass").lower() + b" " if t else b"" for t in texts]
    sizes = np.array([max(0, len(d) - 2) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if not len(flat):
        return np.zeros(0, np.uint32), sizes
    mixed = (flat[:-2] * np.uint32(0x9E3779B1)) ^ (flat[1:-1] * np.uint32(0x85EBCA6B)) ^ (flat[2:] * np.uint32(0xC2B2AE35))
    stays = np.ones(len(flat), bool)
    ends = np.cumsum([len(d) for d in data if d])
    stays[ends - 1] = stays[ends - 2] = False
    return (mixed >> 15)[stays[:-2]] & np.uint32(FEATURES - 1), sizes


class DomainModel:
    """Posterior over domains from letter triples."""

    def __init__(self, samples: Mapping[str, list[str]]):
        self.domains = sorted(samples)
        texts = [(k, t) for k, name in enumerate(self.domains) for t in samples[name]]
        self.sharpness = 1.0
        if len(self.domains) > 1:
            self._count(texts[::2])
            rest = texts[1::2] or texts
            means, truth = self._means([t for _, t in rest]), np.array([k for k, _ in rest])
            losses = [-np.log(self._softmax(means * s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in SHARPNESS]
            self.sharpness = SHARPNESS[int(np.argmin(losses))]
        self._count(texts)

    def _count(self, texts: list[tuple[int, str]]) -> None:
        counts = np.full((FEATURES, max(1, len(self.domains))), 0.5)
        for k in range(len(self.domains)):
            features, _ = _triples([t for d, t in texts if d == k])
            counts[:, k] += np.bincount(features, minlength=FEATURES)
        self.weights = np.log(counts / counts.sum(axis=0))

    def _means(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood of a triple of each text in each domain."""
        features, sizes = _triples(texts)
        means = np.zeros((len(texts), self.weights.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            for k, column in enumerate(np.ascontiguousarray(self.weights.T)):
                means[full, k] = np.add.reduceat(column[features], starts) / sizes[full]
        return means

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        return self._softmax(self._means(texts) * self.sharpness)


def fit_domains(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain",
                per_domain: int = SAMPLE_PER_DOMAIN, chars: int = SAMPLE_CHARS) -> DomainModel:
    return DomainModel(labelled_sample(labelled, doc_id, text, domain, per_domain, chars))


def rates_after(steps: np.ndarray, posteriors: np.ndarray, least: float) -> np.ndarray:
    """The rates of documents after all steps: each moves along its posterior and is projected to ``least``."""
    rates = np.ones(len(posteriors))
    for step in steps:
        rates = np.maximum(least, rates - posteriors @ step)
    return rates


def membership(docs: DataFrame, model: DomainModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posteriors) of every row; tokens are words between white space."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = shared.value.posteriors(texts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
        tokens = pa.array([len(t.split()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens, lists], names=["doc_id", "n_tokens", "posteriors"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, run, f"doc_id {rows.dtypes[0][1]}, n_tokens long, posteriors array<double>")


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, domains)


def _collected(members: DataFrame, size: int, domains: int, sums) -> np.ndarray:
    """Sum over all documents of the ``size`` numbers that ``sums(posteriors, tokens)`` gives for a batch."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += sums(_matrix(batch.column("posteriors"), domains), batch.column("n_tokens").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    parts = members.select("n_tokens", "posteriors").mapInArrow(run, "s array<double>")
    return np.array([v or 0.0 for v in parts.agg(*[F.sum(F.col("s")[i]) for i in range(size)]).first()])


def _totals(members: DataFrame, domains: int, steps: np.ndarray, least: float) -> np.ndarray:
    """Expected tokens of each domain after ``steps``."""
    return _collected(members, domains, domains, lambda p, n: (rates_after(steps, p, least) * n) @ p)


def _curvature(members: DataFrame, domains: int, steps: np.ndarray, least: float, error: np.ndarray) -> np.ndarray:
    """Tokens shared by each pair of domains in the documents whose rate can follow the gradient."""

    def sums(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        free = (rates_after(steps, p, least) > least) | (p @ error < 0)
        return ((p * (n * free)[:, None]).T @ p).ravel()

    return _collected(members, domains * domains, domains, sums).reshape(domains, domains)


def fit_rates(members: DataFrame, domains: list[str], targets: Mapping[str, float], least: float = 1.0,
              headroom: float = HEADROOM, rounds: int = ROUNDS) -> np.ndarray:
    """The steps that take the expected tokens of the domains to their targets; distributed sums of a few numbers each.

    The gradient is scaled by the curvature among the documents that are free to follow it, and a step is halved until
    the error falls. Where the targets cannot be met the last step that helped ends it.
    """
    k = len(domains)
    steps = np.zeros((0, max(1, k)))
    weights = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    if not weights.sum():
        return steps
    current = _totals(members, k, steps, least)
    listed = weights > 0
    weights = weights / weights.sum()
    total = headroom * (current[listed] / weights[listed]).max()
    if not total:
        return steps
    goal = np.where(listed, weights * total, current)
    error = (current - goal) / total
    for _ in range(rounds):
        if np.abs(error).max() < TOLERANCE:
            break
        curvature = _curvature(members, k, steps, least, error) / total
        largest = np.linalg.eigvalsh(curvature).max()
        if largest <= 0:
            break
        scaled = np.linalg.pinv(curvature, rcond=1e-9, hermitian=True) @ error
        for step in (scaled, scaled / 2, scaled / 4, scaled / 8, error / largest):
            longer = np.vstack([steps, step])
            after = (_totals(members, k, longer, least) - goal) / total
            if after @ after < (error @ error) * (1 - 1e-6):
                break
        else:
            break
        steps, error = longer, after
    return steps


def _fraction(key) -> F.Column:
    """A stable number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("copies")), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str = "doc_id", text: str = "text",
        domain: str = "domain", least: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) of every row: its likeliest domain and how often it is used."""
    model = fit_domains(labelled, doc_id, text, domain)
    members = staged(membership(docs, model, doc_id, text))
    steps = fit_rates(members, model.domains, targets, least)
    domains, width = list(model.domains), max(1, len(model.domains))

    def run(batches):
        for batch in batches:
            p = _matrix(batch.column("posteriors"), width)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            rates = _rates(steps, p, batch.column("n_tokens").to_numpy(), least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"),
                 pa.array([domains[b] if domains else None for b in best], pa.string()),
                 pa.array(p[np.arange(len(p)), best]), pa.array(rates)],
                names=["doc_id", "n_tokens", "domain", "posterior", "rate"],
            )

    schema = f"doc_id {members.dtypes[0][1]}, n_tokens long, domain string, posterior double, rate double"
    return members.mapInArrow(run, schema).withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def _rates(steps: np.ndarray, posteriors: np.ndarray, tokens: np.ndarray, least: float) -> np.ndarray:
    return np.where(tokens > 0, rates_after(steps, posteriors, least), max(1.0, least))


def _copies(rate, key) -> F.Column:
    return (F.floor(rate) + (_fraction(key) < rate - F.floor(rate)).cast("long")).cast("int")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str = "doc_id",
                    text: str = "text", domain: str = "domain", least: float = 1.0) -> DataFrame:
    """``docs`` with each row as often as its rate says. Posteriors are computed again rather than joined to the texts."""
    model = fit_domains(labelled, doc_id, text, domain)
    steps = fit_rates(staged(membership(docs, model, doc_id, text)), model.domains, targets, least)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        tokens = np.array([len(t.split()) for t in texts])
        rates = _rates(steps, shared.value.posteriors(texts), tokens, least)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=[*batch.schema.names, "__rate"])

    rated = map_text(docs, run, StructType([*docs.schema.fields, StructField("__rate", DoubleType())]), text)
    times = F.explode(F.sequence(F.lit(1), _copies(F.col("__rate"), F.col(doc_id))))
    return rated.filter(_copies(F.col("__rate"), F.col(doc_id)) > 0).withColumn("__copy", times).select(*docs.columns)
