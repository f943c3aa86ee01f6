"""SentencePiece encoding against the sentencepiece library."""

import hashlib
import random
import time

import pytest
import sentencepiece
from conftest import MEDIUM

from casewright.llm import queries, sentence_piece

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
ODD = [None, "", " ", "\n", "a", " a  b ", "▁▁x", "é\0x", "<0x41>", "</s> <s> <unk>", "ﬁ Å", "\r\n\t ", "日本語のテキスト", "😀😀 x", "a" * 500, " " * 100 + "x" + " " * 33, "x=" * 300, "\n" * 40, "áb‍c"]


@pytest.fixture(scope="module")
def model():
    return sentence_piece.Model(queries.PIECE_BPE)


def same(model, texts):
    for (ids, n, decoded), text in zip(model.encode(texts), texts):
        expected = LIBRARY.encode(text, add_eos=True)
        assert (ids, n, decoded) == (" ".join(map(str, expected)), len(expected), LIBRARY.decode(expected)), text[:80]
        assert model.decode(expected) == decoded


def test_texts_of_pieces_letters_and_spaces(model):
    rnd = random.Random(3)
    pieces = list(model.id_of)
    same(model, ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8))).replace("▁", " ") for _ in range(3000)])
    same(model, ["".join(rnd.choice("abcdeinorst  e") for _ in range(rnd.randint(1, 200))) for _ in range(1000)])
    same(model, ["".join(rnd.choice("  \n\t<>0x▁aé日本😀\0\r(){}--==__") for _ in range(rnd.randint(1, 60))) for _ in range(1000)])
    same(model, [t or "" for t in ODD] + [" " * n for n in range(70)] + ["a" + " " * n + "b" for n in range(70)])


def test_long_words_and_full_memories(model, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("etaoinshr") for _ in range(5000)), "".join(rnd.choice("日本語漢字かな") for _ in range(3000)), "=" * 3000]
    same(model, texts)
    monkeypatch.setattr(sentence_piece, "PAIRS", 50)
    monkeypatch.setattr(sentence_piece, "REMEMBERED", 5)
    small = sentence_piece.Model(queries.PIECE_BPE)
    for k in range(5):
        same(small, ["".join(rnd.choice("etaoinshr ") for _ in range(300)) for _ in range(5)] + texts[:1])


def test_a_long_word_takes_linear_time(model):
    text = "ab" * 500_000
    began = time.time()
    (ids, n, decoded), = model.encode([text])
    assert time.time() - began < 20 and decoded == text and ids == " ".join(map(str, LIBRARY.encode(text, add_eos=True)))


def test_rows(spark):
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(ODD)] + [(None, "no id", "x", 1, 2), (3, "a", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int, n int")
    got = sentence_piece.encode_pieces(docs, queries.PIECE_BPE).collect()
    assert len(got) == len(rows) and [r["ids"] for r in got if r["doc_id"] == 0] == [[LIBRARY.eos_id()]]
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded"] == LIBRARY.decode(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sentence_piece.encode_pieces(docs.limit(0), queries.PIECE_BPE).count() == 0


def test_query_equals_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op12_sentence_piece"](spark, MEDIUM).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
