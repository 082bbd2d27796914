import random
import zlib

import numpy as np
from helpers import EDGES, documents
from tokenizers import Tokenizer

from docproof.llm import token_files
from docproof.llm.common import shared_folder
from docproof.llm.queries import QUERIES, tokenizer_file

MODEL = tokenizer_file("byte_bpe_50k.json").decode()


def test_chunked_encoding_equals_the_library():
    rnd, library, encoder = random.Random(3), Tokenizer.from_str(MODEL), token_files.TextEncoder(MODEL)
    assert encoder.chunked
    alphabet = "ab Z\n\t.,!'s’éßÿ×½²1٣漢 \x1c\x85|*&$#_-<>t"
    texts = ["", "<|endoftext|>", "a  <|endoftext|> b", "don't  I'll 's x's,'s", "x.\n\nY", " " * 50]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(5000)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts():
    model = tokenizer_file("word_bpe_49k.json").decode()
    encoder = token_files.TextEncoder(model)
    want = Tokenizer.from_str(model).encode("Two  words", add_special_tokens=False).ids
    assert not encoder.chunked and np.frombuffer(encoder.encode(["Two  words"])[0], "<u4").tolist() == want


def expected(texts):
    library = Tokenizer.from_str(MODEL)
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_edge_rows_files_and_random_access(spark):
    docs = documents(spark, EDGES)
    folder = f"{shared_folder(spark)}/tokens"
    manifest = token_files.write_tokens(docs, MODEL, 2, folder, sequence=64, vocabulary=50_257)
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert len(rows) == len(EDGES)
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    by_id = dict(zip([i for i, _ in EDGES], expected([t for _, t in EDGES])))
    at = 0
    for r in rows:
        want = by_id[r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(want))
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    stream = [x for i in ids for x in by_id[i]]
    seen = []
    for file in manifest.orderBy("part").collect():
        opened = token_files.SequenceFile(file["sequences"])
        count = -(-file["n_tokens"] // 64)
        for k in range(count):
            values, mask = opened.sequence(k)
            assert len(values) == len(mask) == 64 and mask.all() == (k < count - 1 or file["n_tokens"] % 64 == 0)
            seen += values[mask].tolist()
        assert np.concatenate(list(opened.tokens(0, file["n_tokens"]))).tolist() == seen[-file["n_tokens"] :]
    assert seen == stream


def test_empty_table(spark):
    assert token_files.token_files(documents(spark, EDGES).limit(0), MODEL, 2).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op8_token_files"](spark, folder).collect()}
    at = 0
    for (i, _), want in zip(texts, expected([t for _, t in texts])):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
