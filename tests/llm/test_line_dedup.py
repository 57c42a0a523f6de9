from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from marque.llm import line_dedup
from marque.llm import queries as q
from marque.llm.line_dedup import dedup_lines
from tests.llm.test_similarity import brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def one_letter_apart(seed):
    """A line of 60 letters, and itself with one inner letter changed: 0.8 by six-character shingles, 0.7 by nine."""
    rnd = random.Random(seed)
    a = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    return a, a[:30] + ("#" if a[30] != "#" else "+") + a[31:]


def test_query_and_stage_compare_six_character_shingles(spark, tmp_path):
    rows = [(2 * i + j, x) for i in range(40) for j, x in enumerate(one_letter_apart(i))]
    gone = {i for i, _ in brute_lines(rows, k=6)}
    assert len(gone) == 40 and not brute_lines(rows, k=9)
    d = folder(spark, tmp_path, rows)
    out = {r.doc_id: r.n_removed for r in q.op7_line_dedup(spark, d).collect()}
    assert {i for i, n in out.items() if n} == gone
    assert {r.doc_id for r in cp.line_dedup(spark, q.table(spark, d, "documents"), d).collect()} == set(out) - gone


@pytest.mark.parametrize("band_lines", [1000, 20])
def test_every_pair_of_a_wide_band_is_compared(spark, monkeypatch, band_lines):
    """Lines of one frame share bands though most are unlike; like ones among them mustn't depend on a centre."""
    monkeypatch.setattr(line_dedup, "BAND_LINES", band_lines)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    frame = [word(8) for _ in range(30)]
    rows = []
    for i in range(60):
        x, y, z = rnd.sample(range(30), 3)
        own = word(8)
        for j, k in enumerate((y, z)):
            line = list(frame)
            line[x], line[k] = own, word(8)
            rows.append((2 * i + j, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {i for i, _ in brute_lines(rows, k=6)}
    assert 60 <= len(gone) <= 80
    assert {r.doc_id for r in dedup_lines(df, shingle=6).where("n_removed > 0").collect()} == gone


def test_query_and_stage_keep_each_short_line_once(spark, tmp_path):
    rnd = random.Random(9)
    long_line = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=60)) for _ in range(4)]
    texts = [f"Home\n\n{long_line[0]}\nhome", f"HOME\n \n{long_line[1]}\nÉ\né\nab", f"{long_line[2]}\nab\n\nonly here", f"{long_line[3]}\nx" + "y" * 38, "x" + "y" * 38 + "\nlast", "ab\nnew", "ab\nnew", None, ""]
    want = [f"Home\n\n{long_line[0]}", f" \n{long_line[1]}\nÉ\né\nab", f"{long_line[2]}\n\nonly here", f"{long_line[3]}\nx" + "y" * 38, "last", "new", "", None, ""]
    d = folder(spark, tmp_path, list(enumerate(texts)))
    out = {r.doc_id: r for r in q.op7_line_dedup(spark, d).collect()}
    assert [out[i].text_sha256 for i in range(9)] == [t if t is None else hashlib.sha256(t.encode()).hexdigest() for t in want]
    assert [out[i].n_removed for i in range(9)] == [1, 1, 1, 0, 1, 1, 2, 0, 0]
    staged = {r.doc_id: r.text for r in cp.line_dedup(spark, q.table(spark, d, "documents"), d).collect()}
    assert {i: t for i, t in staged.items() if i < 4} == dict(enumerate(want[:4]))


def test_stage_keeps_documents_with_short_lines_of_their_own(spark, tmp_path):
    licence, poem = "Permission is hereby granted to everyone to use this text.", "A rose\n\nis a rose"
    rows = [(1, f"{licence}\nfirst"), (2, f"{licence}\n{poem}"), (3, f"{licence}\n\nfirst\n \n"), (4, licence.upper()), (5, "first")]
    d = folder(spark, tmp_path, rows)
    out = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, q.table(spark, d, "documents"), d).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: (poem, len(poem))}


def some_documents():
    rnd = random.Random(21)
    pool = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=rnd.randint(40, 90))) for _ in range(150)]
    pool += [x[:30] + "#" + x[31:] for x in pool[:60]] + ["Home", "home", "next"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 6)))) for i in range(120)]
    return [*rows, (500, None), (None, pool[0]), (501, rows[3][1])]


def lines_left(docs, **given):
    return sorted((tuple(r) for r in dedup_lines(docs, shingle=6, short_lines=True, **given).collect()), key=repr)


@pytest.mark.parametrize("bits", [3, 8, 12])
def test_lines_whose_hashes_meet_are_told_apart(spark, bits):
    df = spark.createDataFrame(some_documents(), "doc_id long, text string").repartition(3)
    assert lines_left(df, hash_bits=bits) == lines_left(df)


def test_two_levels_of_dealing_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(some_documents(), "doc_id long, text string").repartition(3)
    want = lines_left(df)
    deal = line_dedup.Deal.of
    monkeypatch.setattr(line_dedup.Deal, "of", lambda spark, blocks: deal(spark, 300))
    assert deal(spark, 300).levels == 2
    assert lines_left(df) == want


def test_few_unlike_pairs_of_long_lines_are_compared_as_sets(monkeypatch):
    """Of lines that share half their shingles the bitmaps tell nearly all pairs apart; links are those of brute force."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    frame = [word() for _ in range(60)]
    lines = []
    for i in range(40):
        own = frame[:]
        for j in rng.sample(range(60), 12):
            own[j] = word()
        lines.append(" ".join(own))
        if i % 10 == 0:
            own[0] = word()
            lines.append(" ".join(own))
    tried, like = [], line_dedup._like
    monkeypatch.setattr(line_dedup, "_like", lambda p, q, percent: tried.append(0) or like(p, q, percent))
    ids = np.arange(len(lines))
    sets = [{x[i : i + 6] for i in range(len(x) - 5)} for x in lines]
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(near) == 4
    for links in (line_dedup._forest(np.zeros(len(lines), np.int64), ids, ids, lines, 80, 6), line_dedup._wide(ids, ids, lines, 80, 6)):
        assert {(min(a, b), max(a, b)) for a, b in zip(*(x.tolist() for x in links), strict=True)} == near
    assert 8 <= len(tried) <= 24


def test_a_text_of_null_ids_alone_is_no_copy(spark):
    """And one of a null and another id is: the null one comes after."""
    line = "a line that is long enough to be compared with others"
    rows = [(None, line), (None, line), (5, line + " elsewhere, and much more of it"), (None, line + " elsewhere, and much more of it")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), shingle=6).select("doc_id", "n_lines", "n_removed").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (0, 1), (5, 0)]
