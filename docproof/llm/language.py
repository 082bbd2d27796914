"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of it. A text is parsed greedily into
the longest phrases each automaton knows; a character that cannot go on ends the phrase and opens the next one. The
phrase count, normalised by the logarithm of the size of the language's own text, is the cross-entropy of the text
against the language, and the language needing least wins. All documents of a batch move through all automata in
lockstep, one character at a time, as array operations.

The automata are fitted on a bounded sample of labelled rows (``docs_per_language``, ``chars_per_language``); every
text is parsed whole. Every letter of the samples is learned: the ``SINGLE_SYMBOLS`` commonest are one symbol each, any
other is a pair of a high and a low symbol, so that the tables stay narrow for languages written in thousands of signs.
A pair counts as two characters of the sample. A letter that no sample holds ends a phrase.

The score only says how far the winner leads. ``accepted`` also asks that a text fits the winner at all: its bits a
letter may be ``UNUSUAL`` times what labelled texts need that were left out of an automaton of the other texts (nine in
ten pieces of them need less), and ``SHORT_PHRASES`` phrases more, so that short texts are not judged by chance.

Edge cases: a text that is null or has no letter gives ``und`` with score 0; ties go to the alphabetically first
language; rows without text or label teach nothing; with no labelled row every text is ``und``; repeated rows and very
long texts are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docproof.llm.common import keep_where, labelled_sample, map_text

DOCS_PER_LANGUAGE = 256
CHARS_PER_LANGUAGE = 40_000
SINGLE_SYMBOLS = 126
LEAST_SCORE = 0.4
UNUSUAL = 2.25
SHORT_PHRASES = 8
PIECE, LEAST_LETTERS = 400, 100  # of a left-out text: characters of a piece, letters of one whose rate counts
LEAST_TEXTS, LEAST_PIECES = 2, 10  # left out of a language
SLICE = 3 << 20  # bytes of text that move through the automata together
GAP, UNKNOWN = 0, 1
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def automaton(text: list[int], symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text``: [state, symbol] -> state, 0 (the start) where there is none."""
    moves: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(moves), symbols), np.int32)
    for state, row in enumerate(moves):
        for c, target in row.items():
            table[state, c] = target
    return table


class LanguageModel:
    """Automata of all languages in one table; small enough to be sent to every task."""

    def __init__(self, samples: dict[str, list[str]], chars: int = CHARS_PER_LANGUAGE):
        self.languages = sorted(samples)
        letters = _is_letter()
        counts: dict[int, int] = {}
        taken: dict[str, np.ndarray] = {}
        for name in self.languages:
            parts, left = [], chars
            for text in samples[name]:
                points = _points(text)[:left]
                parts += [np.array([32], np.uint32), points]
                left -= len(points)
                if left <= 0:
                    break
            taken[name] = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            for c, n in zip(*np.unique(taken[name][letters[taken[name]]], return_counts=True)):
                counts[int(c)] = counts.get(int(c), 0) + int(n)
        ranked = sorted(counts, key=lambda c: (-counts[c], c))
        common, rare = ranked[:SINGLE_SYMBOLS], ranked[SINGLE_SYMBOLS:]
        self.base = math.isqrt(max(0, len(rare) - 1)) + 1 if rare else 0
        self.high = 2 + len(common)
        self.symbols = self.high + 2 * self.base
        self.codes = np.where(letters, UNKNOWN, GAP).astype(np.int32)
        self.codes[common] = np.arange(2, self.high)
        self.codes[rare] = self.symbols + np.arange(len(rare))
        tables, starts, self.rates, at = [], [], [], 0
        for name in self.languages:
            codes = self._squeeze(self._pairs(self.codes[taken[name]])[0])[0][: len(taken[name])]
            table = automaton(codes.tolist(), self.symbols)
            # A missing move ends the phrase: it is stored as the complement of where the next phrase goes on.
            table = np.where(table > 0, (table + at) * self.symbols, ~((table[0] + at) * self.symbols)).astype(np.int32)
            starts.append(at * self.symbols)
            tables.append(table.ravel())
            at += len(table)
            self.rates.append(math.log2(max(2, len(codes))))
        self.usual = np.full(len(self.languages), np.inf)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.starts = np.array(starts, np.int32)

    def _pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes with every rare letter as its two symbols; also how many symbols each code became."""
        rare = codes >= self.symbols
        width = 1 + rare.astype(np.int64)
        out = np.repeat(codes, width)
        low = np.cumsum(width)[rare] - 1
        number = codes[rare] - self.symbols
        out[low - 1] = self.high + number // max(1, self.base)
        out[low] = self.high + self.base + number % max(1, self.base)
        return out, width

    @staticmethod
    def _squeeze(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of non-letters become one gap; also which codes stay."""
        stays = np.ones(len(codes), bool)
        stays[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        return codes[stays], stays

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the number of its letters."""
        n, k = len(texts), len(self.languages)
        points = [_points(t) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        joined = np.concatenate(points) if n else np.zeros(0, np.uint32)
        codes = self.codes[joined]
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        letters = np.bincount(owner[codes != GAP], minlength=n)
        if self.base:
            codes, width = self._pairs(codes)
            owner = np.repeat(owner, width)
            sizes = np.bincount(owner, minlength=n)
        ends = np.cumsum(sizes)
        stays = self._squeeze(codes)[1]
        stays[(ends - sizes)[sizes > 0]] = True
        codes, owner = codes[stays], owner[stays]
        sizes = np.bincount(owner, minlength=n)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        first = begins[order]
        state = np.repeat(self.starts[:, None], n, axis=1)
        count = np.zeros((k, n), np.int32)
        for step, active in enumerate(running.tolist()):
            here = state[:, :active]
            move = self.table[here + codes[first[:active] + step]]
            ended = move >> 31
            count[:, :active] -= ended
            np.bitwise_xor(move, ended, out=here)
        count += state != self.starts[:, None]
        out = np.empty((n, k), np.int64)
        out[order] = count.T
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the winner's share when every phrase more than the best costs
        a factor e, so it grows with the length of the text and the lead."""
        names, score, _ = self.judge(texts)
        return names, score

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text fits that language, by the bits a letter that are usual for it."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        count, letters = self.phrases(texts)
        bits = count * np.array(self.rates)
        best = bits.argmin(axis=1)
        fits = bits.min(axis=1) - SHORT_PHRASES * np.array(self.rates)[best] <= UNUSUAL * self.usual[best] * np.maximum(letters, 1)
        lead = (bits - bits.min(axis=1, keepdims=True)) / np.mean(self.rates)
        score = 1.0 / np.exp(-lead).sum(axis=1)
        names = [self.languages[b] if c else UNDETERMINED for b, c in zip(best, letters)]
        return names, np.where(letters > 0, score, 0.0), fits


def usual_bits(samples: dict[str, list[str]], chars: int = CHARS_PER_LANGUAGE) -> dict[str, float]:
    """Bits a letter that nine in ten pieces of left-out texts of each language need at most; infinite where too few are left out.

    Every second distinct text teaches automata of half the size, the others are parsed with them.
    """
    texts = {name: sorted(set(found)) for name, found in samples.items()}
    half = LanguageModel({name: found[::2] for name, found in texts.items()}, chars // 2)
    usual = {}
    for k, name in enumerate(half.languages):
        left_out = [t for t in texts[name][1::2] if len(t) >= LEAST_LETTERS]
        pieces = [t[at : at + PIECE] for t in left_out for at in range(0, len(t), PIECE)]
        count, letters = half.phrases(pieces)
        rates = (count[:, k] * half.rates[k] / np.maximum(letters, 1))[letters >= LEAST_LETTERS]
        enough = len(left_out) >= LEAST_TEXTS and len(rates) >= LEAST_PIECES
        usual[name] = float(np.quantile(rates, 0.9)) if enough else math.inf
    return usual


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        docs_per_language: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows that have a text and a language."""
    samples = labelled_sample(labelled, doc_id, text, lang, docs_per_language, chars)
    model, usual = LanguageModel(samples, chars), usual_bits(samples, chars)
    model.usual = np.array([usual[name] for name in model.languages])
    return model


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(keep or []), F.col(text).alias("__text"))
    kept = rows.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict([t or "" for t in batch.column("__text").to_pylist()])
        columns = [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_text(rows, run, schema, "__text", SLICE)


def accepted(docs: DataFrame, model: LanguageModel, least_score: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language the model knows, with at least ``least_score`` and fitting it; the others go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts: list[str]) -> np.ndarray:
        names, scores, fits = shared.value.judge(texts)
        return (np.array(names) != UNDETERMINED) & (scores >= least_score) & fits

    return keep_where(docs, accept, text, SLICE)
