from __future__ import annotations

import hashlib
import random

import pytest

from marque.llm.bpe import RunCache, WordBpe, merge_rounds
from marque.llm.bpe_codec import codec_digests, decode, encode
from marque.llm.token_counts import token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["", "  \n", "Hello WORLD's 12!", "Héllo ﬁ Å é", "ΣΑΣ İ ß", "a<|endoftext|>b <|x|> <|ENDOFTEXT|>", "aaaa aaaaa ababab", "a\x1cb\x85c d", "😀‍中文 x", "a\U00011935\U00011930b \U00011938", "re're I'll", "word*** &&&" * 50, "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_equals_the_library(library):
    bpe = WordBpe(PATH)
    cache = RunCache(bpe, lambda ids: ids)
    random.seed(1)
    bits = ["a", "b", "aa", "'", "s", "ll", "re", "1", "23", " ", "\n", "é", "é", "Σ", "<|endoftext|>", "<|", "!", "!!", "中", "\x1c", "\xa0"]
    texts = TEXTS + ["".join(random.choices(bits, k=random.randint(0, 15))) for _ in range(3000)]
    mine = [[i for run in x for i in run] for x in cache.of([bpe.runs(t) for t in texts])]
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine == theirs
    assert [bpe.decode(i) for i in mine[:50]] == [library.decode(i, skip_special_tokens=False) for i in mine[:50]]


def test_merge_rounds_of_runs_go_from_the_left():
    import numpy as np

    flat, n = merge_rounds(np.array([1, 1, 1, 1, 1, 2]), np.array([5, 1]), np.array([1 * 10 + 1]), np.array([0]), np.array([3]), 10)
    assert flat.tolist() == [3, 3, 1, 2] and n.tolist() == [3, 1]


def test_counts_and_digests(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    got = {r.doc_id: r for r in token_counts(df, PATH, limit=100).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (len(want[i]) > 100) for i, t, _ in rows)
    for r in codec_digests(df, PATH).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_columns_and_empty_table(spark, library):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in decode(encode(df, PATH), PATH).collect()}
    assert out[1].ids == library.encode("Hello world", add_special_tokens=False).ids and out[2].ids == []
    again = {r.doc_id: r for r in encode(encode(df, PATH).withColumnRenamed("doc_id", "decoded"), PATH).withColumnRenamed("decoded", "doc_id").collect()}
    assert again[1].ids == out[1].ids
    assert out[1].decoded == library.decode(out[1].ids, skip_special_tokens=False)
    assert token_counts(df.where("false"), PATH).count() == 0 and codec_digests(df.where("false"), PATH).count() == 0


def test_every_code_point_equals_the_library(library):
    """Alone, within a word and beside a digit; composition is that of Python's own Unicode version."""
    bpe = WordBpe(PATH)
    code_points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bad = []
    for i in range(0, len(code_points), 50_000):
        some = code_points[i : i + 50_000]
        texts = [f"a{chr(c)}b {chr(c)}1" for c in some]
        theirs = library.encode_batch(texts, add_special_tokens=False)
        runs = [bpe.runs(t) for t in texts]
        ids = iter(bpe.encode_runs([r for rs in runs for r in rs]))
        bad += [hex(c) for c, rs, e in zip(some, runs, theirs, strict=True) if [x for _ in rs for x in next(ids)] != e.ids]
    assert not bad
