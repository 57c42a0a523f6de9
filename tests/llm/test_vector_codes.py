"""Operator 13 against a plain reading of its contract in Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from marque.llm.queries import op13_vector_codes
from marque.llm.vector_codes import compress, decode_vectors, encode_vectors, fit_codebooks, partial_distance

SF = "/root/testdata/sf0.001"


def brute(rows, parts=8, entries=16, rounds=6):
    """{vec_id: (code, error, label_error)} and the codebooks; ids are unique and vectors of one length."""
    kept = sorted((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    books = [[v[p * w : p * w + w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * w : p * w + w]
                own[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out, sums = {}, defaultdict(int)
    for i, v, label in kept:
        got = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label)
        sums[label] += out[i][1]
    return {i: (c, e, sums[label]) for i, (c, e, label) in out.items()}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def _same(got, rows):
    expected, digest = brute(rows)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == expected
    assert len(got) == len(expected) and {r["codebooks_sha256"] for r in got} == {digest}


def test_query(spark):
    _same(op13_vector_codes(spark, SF).collect(), [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])


def test_ties_nulls_and_extra_columns(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, -0.0, 0.0, 0.25, 1.0]) for _ in range(16)], rnd.choice([None, 1, 2])) for i in range(300)]
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 2), (303, [float("inf")] + [0.0] * 15, None)]
    frame = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error string").repartition(7)
    _same(compress(frame).collect(), rows)
    _same(compress(frame.where("vec_id < 5")).collect(), [r for r in rows if r[0] < 5])


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert compress(spark.createDataFrame([], kind)).collect() == []
    empty = compress(spark.createDataFrame([(1, [], None), (1, [], None)], kind)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in empty] == [("00" * 8, 0, 0)] * 2
    mixed = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5], 1), (None, [1e300] * 9, 1), (2, [0.5], 1)], kind)
    got = {r["vec_id"]: r["error"] for r in compress(mixed).collect()}
    assert got == {1: 0, 2: 0, None: 0}


def test_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = fit_codebooks(rows)
    codes = encode_vectors(rows, books)
    back = decode_vectors(codes, books).join(rows, "vec_id").select("decoded", "embedding", "error").collect()
    for r in back[:50]:
        off = sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(r["embedding"], r["decoded"], strict=True))
        assert off == r["error"]


@pytest.mark.parametrize("span", [2, 50, 2**27])
def test_search_is_exact(span):
    rng = np.random.default_rng(span)
    for dims in (1, 2, 5, 8):
        x, book = rng.integers(-span, span, (500, dims)), rng.integers(-span, span, (16, dims))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        code, least = partial_distance(x, book)
        assert (code == d.argmin(1)).all() and (least == d.min(1)).all()
