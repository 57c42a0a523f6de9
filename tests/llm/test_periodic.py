"""Operator 12 against brute force: every period, every stretch of equal words that far apart."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from marque.llm.periodic import collapse_runs, find_runs, lz_factors, run_digests, runs_of, text_runs
from marque.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def brute(x, least=6, fold=4):
    out = {}
    for q in range(1, len(x) // fold + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, fold * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def _sequences(n):
    rnd = random.Random(5)
    for _ in range(n):
        k = rnd.choice([1, 2, 2, 3, 4])
        x = [rnd.randrange(k) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 4)):
            y = [rnd.randrange(k) for _ in range(rnd.randint(1, 9))] * rnd.randint(2, 8)
            a = rnd.randint(0, len(x))
            x[a:a] = y[: rnd.randint(1, len(y))]
        yield x * rnd.choice([1, 1, 2, 5])


@pytest.mark.parametrize(("least", "fold"), [(6, 4), (2, 2), (3, 3), (1, 2), (10, 4), (6, 5)])
def test_runs_are_all_runs(least, fold):
    for x in _sequences(400):
        expected = brute(x, least, fold)
        assert sorted(runs_of(x, least, fold)) == sorted(expected), x
        assert text_runs([None, " ".join(map(str, x)), ""], least, fold)[1] == [[], expected, []], x


def test_factors_are_the_longest_earlier_ones():
    for x in _sequences(100):
        at = 0
        for b, n, source in lz_factors(x):
            assert b == at
            at += n
            earlier = [max((k for k in range(len(x) - b + 1) if x[o : o + k] == x[b : b + k]), default=0) for o in range(b)]
            assert n == max(max(earlier, default=0), 1)
            assert (source < 0) == (max(earlier, default=0) == 0)
            assert source < 0 or x[source : source + n] == x[b : b + n]
        assert at == len(x)


def _expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
    longest = (s, e - s, q, 1000 * (e - s) // q) if runs else (None,) * 4
    return (len(runs), *longest, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 8000]
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert any(got[d["doc_id"]]["n_runs"] for d in docs)
    for d in docs:
        assert tuple(got[d["doc_id"]])[1:] == _expected(d["doc_id"], d["text"])


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a " * 6), (None, "b  a b a b a b a\nc"), (4, "a " * 6), (5, "x y " * 50_000), (6, "q" * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, t) for i, t in rows], "doc_id long, text string, runs int, start string")
    got = find_runs(docs).collect()
    runs = {(r["doc_id"], (r["text"] or "")[:4]): [tuple(x) for x in r["runs"]] for r in got}
    assert len(got) == len(rows)
    assert runs == {(1, ""): [], (2, ""): [], (3, " \t"): [], (4, "a a "): [(0, 6, 1)], (None, "b  a"): [(0, 8, 2)], (5, "x y "): [(0, 100_000, 2)], (6, "qqqq"): []}
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in collapse_runs(docs).collect() if r["doc_id"] not in (1, 6))
    assert texts == [(0, "b a c"), (2, ""), (3, " \t"), (4, "a"), (4, "a"), (5, "x y")]
    assert run_digests(docs).count() == len(rows)
    assert run_digests(docs.limit(0)).count() == 0
    assert run_digests(docs.where("doc_id is null")).select("n_runs", "start", "length", "period", "exponent_milli").collect() == [(1, 0, 8, 2, 4000)]
