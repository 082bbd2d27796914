import random

import numpy as np
import pytest
from helpers import EDGES, LONG, documents

from docproof.llm import language
from docproof.llm.queries import QUERIES

SAMPLES = {
    "aa": ["banana bandana ananas", "nab a ban"],
    "bb": ["celtic circle recite", "elect ice"],
    "cc": ["zum zoom muzo", "omu zum"],
}


def slow_phrases(model, name, text):
    """Greedy parse of one text by looking its phrases up in the squeezed sample itself."""
    k = model.languages.index(name)
    taken = []
    for t in SAMPLES[name]:
        taken += [32, *map(ord, t.lower())]
    known = squeeze(symbols(model, taken))[: len(taken)]
    codes = squeeze(symbols(model, map(ord, text.lower())))

    def inside(part):
        return any(known[i : i + len(part)] == part for i in range(len(known) - len(part) + 1))

    count, phrase = 0, []
    for c in codes:
        if inside(phrase + [c]):
            phrase.append(c)
            continue
        count += 1
        phrase = [c] if inside([c]) else []
    return count + bool(phrase), k


def symbols(model, points):
    out = []
    for code in (int(model.codes[c]) for c in points):
        number = code - model.symbols
        out += [code] if number < 0 else [model.high + number // model.base, model.high + model.base + number % model.base]
    return out


def squeeze(codes):
    return [c for i, c in enumerate(codes) if c != language.GAP or i == 0 or codes[i - 1] != language.GAP]


def test_lockstep_parse_equals_a_parse_by_search():
    model, rnd = language.LanguageModel(SAMPLES), random.Random(5)
    texts = ["", "a", "!!", "banana ice", "zzz  zoom, muz"] + [
        "".join(rnd.choice("abcein zumo,.É9") for _ in range(rnd.randint(0, 40))) for _ in range(300)
    ]
    found, letters = model.phrases(texts)
    for row, n, text in zip(found, letters, texts):
        assert n == sum(c.isalpha() for c in text.lower())
        for name in SAMPLES:
            want, k = slow_phrases(model, name, text)
            assert row[k] == want, (name, text)


def test_lockstep_parse_with_rare_letters_as_pairs(monkeypatch):
    monkeypatch.setattr(language, "SINGLE_SYMBOLS", 4)
    model, rnd = language.LanguageModel(SAMPLES), random.Random(6)
    assert model.base == 4 and model.symbols == 2 + 4 + 8  # 16 letters in all, 12 of them in pairs
    texts = ["", "x", "zoom", "banana ice"] + [
        "".join(rnd.choice("abcelmnortuz ,É9") for _ in range(rnd.randint(0, 40))) for _ in range(300)
    ]
    found, letters = model.phrases(texts)
    for row, n, text in zip(found, letters, texts):
        assert n == sum(c.isalpha() for c in text.lower())
        for name in SAMPLES:
            want, k = slow_phrases(model, name, text)
            assert row[k] == want, (name, text)


def test_languages_of_thousands_of_signs_are_told_apart():
    rnd = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(2500)]
    words = {name: ["".join(rnd.choice(signs) for _ in range(2)) for _ in range(1500)] for name in ("xa", "xb")}
    text = lambda name, n: "".join(rnd.choice(words[name]) for _ in range(n))
    samples = {name: [text(name, 250) for _ in range(40)] for name in words}
    samples["en"] = ["the quick brown fox jumps over the lazy dog and runs away from it"] * 40
    model = language.LanguageModel(samples)
    learned = model.codes[[ord(c) for name in words for t in samples[name] for c in t]]
    assert (learned > language.UNKNOWN).all() and len(set(learned.tolist())) > 2000
    names, scores = model.predict([text(name, 60) for name in ("xa", "xb") * 20])
    assert names == ["xa", "xb"] * 20 and scores.min() > 0.9
    assert model.predict(["the lazy fox"])[0] == ["en"]


def test_automaton_accepts_exactly_the_substrings():
    rnd = random.Random(2)
    text = [rnd.randint(0, 2) for _ in range(60)]
    table = language.automaton(text, 3)
    have = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(3000):
        part = tuple(rnd.randint(0, 2) for _ in range(rnd.randint(1, 6)))
        state = 0
        for c in part:
            state = int(table[state, c])
            if not state:
                break
        assert bool(state) == (part in have)


def test_undetermined_ties_and_no_languages():
    model = language.LanguageModel({"b": ["abc"], "a": ["abc"]})
    names, scores = model.predict(["", "12 .", "abc", "漢字"])
    assert names == ["und", "und", "a", "a"] and scores[0] == scores[1] == 0.0 and scores[2] == pytest.approx(0.5)
    names, scores = language.LanguageModel({}).predict(["abc"])
    assert names == ["und"] and scores[0] == 0.0


def test_edge_rows_and_extra_columns(spark):
    docs = documents(spark, EDGES)
    model = language.fit(docs)
    rows = language.predict(docs, model, [docs["doc_id"]]).collect()
    assert len(rows) == len(EDGES) and all(0.0 <= r["score"] <= 1.0 for r in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert found[1] == found[2] == found[3] == found[9] == "und" and found[5] == found[8] == "en"
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, None, 8, 10}
    assert language.predict(docs.limit(0), model, [docs["doc_id"]]).count() == 0
    assert language.fit(docs.limit(0)).languages == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op1_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert len(rows) > 100 and right > 0.95
    assert len(LONG) > 100_000


def test_texts_in_no_learned_language_are_rejected(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.filter("lang is not null"))
    assert np.isfinite(model.usual).all() and (model.usual < 5).all()
    rnd = random.Random(1)
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
              "sumieniem i powinni postępować wobec innych w duchu braterstwa. ")
    strange = ["".join(rnd.choice("абвгдежзийклмно ") for _ in range(n)) for n in (500, 2000, 8000)]
    strange += ["漢字" * 1000, polish * 4, "αβγ δεζ ηθι " * 100]
    rows = documents(spark, list(enumerate(strange)))
    assert language.accepted(rows, model).count() == 0
    # No document of the table is lost by this: the score alone decides as before.
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    names, scores, fits = model.judge(texts)
    assert [t for t, n, f in zip(texts, names, fits) if n != "und" and not f] == []


def test_few_left_out_texts_set_no_limit():
    many = [f"some words of text number {i} and a few more " * 4 for i in range(20)]
    found = language.usual_bits({"a": ["abc"], "b": many[:2], "c": many})
    assert found["a"] == found["b"] == np.inf and 0 < found["c"] < 5
    assert language.usual_bits({}) == {}
