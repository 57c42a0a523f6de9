"""Operator 11 against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from marque.llm.piece_codec import decode_pieces, encode_pieces, piece_digests
from marque.llm.pieces import PieceModel
from marque.llm.queries import op11_piece_codec, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces())


@pytest.fixture(scope="module")
def model():
    return PieceModel(pieces())


def _texts() -> list[str]:
    rnd = random.Random(3)
    alphabet = " ▁\n\t\r\x00aabbcdeeilnorst.,;(){}<>0123é中日ß\U0001f600‍﻿ﬁ́�\x1c\x85 \xa0"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    out += ["".join(rnd.choice("ab ") for _ in range(300)) for _ in range(20)]
    return [*out, "", " ", "\n", "a" * 5000, " " * 777, "▁" * 100 + "x", "<s></s><unk><0x0A>", "".join(map(chr, range(1, 0x3000))), "".join(map(chr, range(0x10000, 0x10400)))]


def test_ids_and_texts_are_the_librarys(library, model):
    texts = _texts()
    chunks = [model.chunks(t) for t in texts]
    distinct = sorted({c for x in chunks for c in x})
    ids = dict(zip(distinct, model.encode_runs(distinct), strict=True))
    for t, x in zip(texts, chunks, strict=True):
        own = [i for c in x for i in ids[c]]
        assert own == library.encode(t), t[:80]
        assert model.decode(own) == library.decode(own)


def test_decode_of_any_ids(library, model):
    rnd = random.Random(7)
    for _ in range(2000):
        ids = [rnd.randrange(rnd.choice([5, 300, 32000])) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_rounds_and_heap_agree(model):
    rnd = random.Random(9)
    words = ["▁" + "".join(rnd.choice("abcdehilnorst") for _ in range(rnd.randint(30, 47))) for _ in range(300)]
    assert model.encode_runs(words) == [tuple(model._heaped(model._symbols([w])[0].tolist())) for w in words]


def test_frames(spark, library):
    texts = [None, "", "  two  spaces\nnew line", "long " * 20_000, "x" * 70_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    back = decode_pieces(encode_pieces(docs, pieces()), pieces())
    for r in back.collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    small = {r["doc_id"]: r for r in piece_digests(docs, pieces(), table_chunks=2).collect()}
    for i, t in enumerate(texts):
        assert small[i]["n_tokens"] == len(library.encode(t or ""))
    assert decode_pieces(spark.createDataFrame([(None,)], "ids array<int>"), pieces()).first()["decoded"] is None
    none = piece_digests(docs.limit(0), pieces())
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_piece_codec(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
