import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import EDGES, documents

from docproof.llm import pieces
from docproof.llm.queries import QUERIES, tokenizer_file

DATA = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(DATA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(n):
    rnd = random.Random(1)
    fixed = ["", " ", "  a  b ", "\n", "▁▁a", "日本語テキスト", "😀 x", "\x00a", "<s> </s> <0x0A>", "é" * 200, "a" * 3000, "ab " * 300]
    return fixed + ["".join(rnd.choice("ab \n▁éß😀.,'<>0x") for _ in range(rnd.randint(1, 90))) for _ in range(n)]


def test_ids_spans_and_text_equal_the_library(model, library):
    texts = odd_texts(1500)
    for text, (ids, spans) in zip(texts, model.encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert model.decode(want) == library.decode(want), text
        proto = library.encode(text, return_type="proto")
        assert spans[1:-1].tolist() == [[p.begin, p.end] for p in proto.pieces], text


def test_spans_spell_the_source(model):
    for text in odd_texts(200):
        ids, spans = model.encode([text])[0]
        data = text.encode()
        assert b"".join(data[a:b] for a, b in spans.tolist()) == data
        assert (spans[1:, 0] >= spans[:-1, 0]).all()


def test_decoding_any_ids(model, library):
    rnd = random.Random(7)
    for _ in range(4000):
        pick = [0, 1, 2, 259, 29871, rnd.randint(3, 258), rnd.randint(3, 258), rnd.randint(259, 31999)]
        ids = [rnd.choice(pick) for _ in range(rnd.randint(0, 7))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("trims", [True, False])
def test_compiled_character_map(model, rule, trims):
    """The rules of compiled maps, and the alignment, against the library's normaliser."""
    other = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=trims, escape_whitespaces=True)
    spec = dict(pieces._fields(other.serialized_normalizer_spec()))
    mine = pieces.PieceModel(DATA)
    mine.map, mine.trims, mine.plain = pieces.CharacterMap(spec[2]), trims, False
    rnd = random.Random(3)
    alphabet = "aÀﬁ①Ａ ㌀é 　­가각ǅ²½\t ß"
    for text in ["", "  ", " a ", "ﬁ ﬁ"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(400)]:
        want, places = other.normalize(text, with_offsets=True)
        got, source = mine.normalize(text)
        assert got == want, (text, got, want)
        starts = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        assert source.tolist() == [int(starts[p]) for p in places], text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"\x0a\x05\x0a\x01a\x18\x04" + DATA)


def test_edge_rows_and_extra_columns(spark, library):
    docs = documents(spark, EDGES)
    rows = pieces.digest_documents(docs, DATA).collect()
    texts = {i: t or "" for i, t in EDGES}
    assert len(rows) == len(EDGES)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    full = pieces.encode_documents(docs, DATA).collect()
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["stops"]) == r["n_tokens"] for r in full)
    assert pieces.digest_documents(docs.limit(0), DATA).count() == 0


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
