"""Long texts, null and repeated ids, extra columns and generated pages, for the operators whose own tests have none."""

from __future__ import annotations

import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from marque.llm import queries as q
from marque.llm.html_text import extract_text
from marque.llm.line_dedup import dedup_lines
from marque.llm.lm_scores import lm_scores
from marque.llm.ngram_join import jaccard_components, near_copies
from marque.llm.ann import nearest
from marque.llm.quality import LineCRF, fit_quality, line_features, score_quality

SF = Path("/root/testdata/sf0.01")


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    """Two texts of 100,000 lines, half of them alike; the work grows with the lines, not with their square."""
    rnd = random.Random(1)
    line = lambda i: f"line {i} " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    common = [line(i) for i in range(50_000)]
    texts = ["\n".join(common + [line(i) for i in range(50_000)]) for _ in range(2)]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in dedup_lines(df, shingle=6, short_lines=True).collect()}
    assert time.monotonic() - began < 240
    assert out[1].text == texts[0] and (out[2].n_lines, out[2].n_removed) == (100_000, 50_000)


def test_line_dedup_recall_of_near_copies(spark):
    """Lines with one or two changed words, just over the bound: banding finds nearly all that brute force links."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9)))
    rows, want = [], 0
    shingles = lambda x: {x[i : i + 6] for i in range(len(x) - 5)}
    for i in range(1500):
        words = [word() for _ in range(20)]
        other = list(words)
        for _ in range(rnd.choice((1, 1, 2))):
            other[rnd.randrange(20)] = word()
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        want += 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b))
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), shingle=6).where("n_removed > 0").count()
    assert want > 300 and 0.99 * want <= found <= want


@pytest.mark.parametrize("pairs", [0, 40, 10**6])
def test_a_wide_place_links_what_brute_force_does(pairs, monkeypatch):
    from marque.llm import line_dedup
    from tests.llm.test_similarity import components

    monkeypatch.setattr(line_dedup, "NEAR_PAIRS", pairs)
    rnd = random.Random(6)
    lines = ["the quick brown fox jumps over the lazy dog and runs along " + "".join(rnd.choices("abcd", k=rnd.randint(4, 16))) for _ in range(120)]
    sets = [{x[i : i + 6] for i in range(len(x) - 5)} for x in lines]
    want = components(120, [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    ids = np.arange(120)
    a, b = line_dedup._wide(ids, ids, lines, 80, 6)
    assert components(120, list(zip(a.tolist(), b.tolist(), strict=True))) == want and len(a) == 120 - len(set(want))


def test_wide_bands_lose_no_link(spark, monkeypatch):
    """Many unlike lines of one frame in wide bands: every pair over the bound is linked, within blocks and across."""
    from marque.llm import line_dedup
    from tests.llm.test_similarity import components

    monkeypatch.setattr(line_dedup, "BAND_LINES", 20)
    rnd = random.Random(3)
    frame = "the quick brown fox jumps over the lazy dog and runs along the river bank to find the old stone bridge "
    lines = [frame + "".join(rnd.choices("abcdefghij", k=rnd.randint(8, 26))) for _ in range(300)]
    lines += [x[: -rnd.randint(1, 3)] for x in lines[::4]]
    sets = [{x[i : i + 6] for i in range(len(x) - 5)} for x in lines]
    comp = components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in dedup_lines(df, shingle=6).where("n_removed > 0").collect()}
    assert got == {i for i, c in enumerate(comp) if c != i}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g"), (2, "u v w x y z"), (2, "one two three four five"), (3, "one two three four five"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 3, 1), (None, 3, 1), (1, 3, 1), (2, 2, 2), (2, 1, 2), (3, 1, 2), (None, 0, None)], key=repr)
    gone = near_copies(df).collect()
    assert [r.id for r in gone] == [1, 3] or sorted(r.id for r in gone) == [1, 3]
    scores = lm_scores(df).collect()
    assert len(scores) == 7 and sorted(r.n_tokens for r in scores) == [0, 5, 5, 6, 7, 7, 7]
    lines = spark.createDataFrame([(None, "x" * 50), (1, "x" * 50), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(lines).collect() if r.doc_id) == [(1, "x" * 50)] and sorted(str(r.text) for r in dedup_lines(lines).collect()) == ["", "None", "x" * 50]
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert score_quality(df, fit_quality(df, labels)).count() == 7


def test_nearest_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id = 3"), k=5).orderBy("rank").collect()]
    assert got == [(3, 1), (3, 2), (3, 1)]


def test_long_texts_of_scores_and_joins(spark):
    rnd = random.Random(4)
    words = rnd.choices([f"w{i}" for i in range(3000)], k=200_000)
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, "short text")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_tokens for r in lm_scores(df).collect()} == {1: 200_000, 2: 190_000, 3: 2}
    assert score_quality(df, LineCRF.zero()).count() == 3


def _page(rnd: random.Random, named: bool) -> tuple[str, str]:
    """A page made of blocks, and the text that is its article."""
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "d&amp;e", "x &lt; y", "caf&eacute;", "&#8220;quoted&#8221;", "naïve"])
    plain = {"d&amp;e": "d&e", "x &lt; y": "x < y", "caf&eacute;": "café", "&#8220;quoted&#8221;": "“quoted”"}
    away = [
        lambda: f"<nav><ul><li><a href='/{rnd.random()}'>{word()}</a></li><li>{word()}</li></ul></nav>", lambda: f"<div class='sidebar'><p>{' '.join(word() for _ in range(30))}</p></div>", lambda: f"<aside><p>{word()}</p></aside>",
        lambda: f"<script>var a = '<p>{word()}</p>';</script><style>p {{ color: red }}</style>", lambda: f"<form><input name=q><button>{word()}</button></form>", lambda: f"<div id=\"cookie-notice\">{word()} {word()}</div>", lambda: f"<!-- {word()} -->", lambda: f"<div class=\"ad-banner\"><p>{word()}</p></div>",
    ]
    body, text = [], []
    for _ in range(rnd.randint(2, 9)):
        ws = [word() for _ in range(rnd.randint(18, 40))]
        shown = [plain.get(w, w) for w in ws]
        inner = [f"<b>{w}</b>" if rnd.random() < 0.1 else f"<a href='#'>{w}</a>" if named and rnd.random() < 0.1 else w for w in ws]
        body.append(f"<{(t := rnd.choice(['p', 'blockquote', 'h2']))}>\n " + rnd.choice([" ", "\n\t", "  "]).join(inner) + f" </{t}>")
        text.append(" ".join(shown))
        if named and rnd.random() < 0.4:
            body.append(rnd.choice(away)())
    main = "".join(body)
    main = f"<article>{main}</article>" if named else f"<div>{main}</div>"
    around = lambda: "".join(rnd.choice(away)() for _ in range(rnd.randint(0, 4)))
    comments = f"<section class='comments'><p>{' '.join(word() for _ in range(30))}</p></section>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body><header><p>{word()}</p></header>{around()}{main}{comments}{around()}<footer>{word()}</footer></body></html>", "\n\n".join(text)


@pytest.mark.parametrize("named", [True, False])
def test_extracted_text_is_what_pages_were_made_of(spark, named):
    rnd = random.Random(5)
    pages = [_page(rnd, named) for _ in range(120)] + [("<article>" + "<p>long text here</p>" * 30_000 + "</article>", "\n\n".join(["long text here"] * 30_000))]
    df = spark.createDataFrame([(i, None, p, "clash") for i, (p, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(pages)}


def test_scores_are_length_weighted_marginals():
    """Against the sum over all labellings of a text's lines."""
    texts = [b"Aa bb cc dd.\nXX!! YY ###\nfoo | bar\n\nlast line of it", b"only one line here"]
    x, size, counts = line_features(texts)
    rnd = np.random.default_rng(9)
    m = LineCRF.zero()
    for k in ("own", "before", "after", "bias", "move"):
        setattr(m, k, rnd.normal(size=getattr(m, k).shape))
    u = m.potentials(x, counts)
    at = 0
    for got, n in zip(m.scores(texts), counts.tolist(), strict=True):
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            s = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(s[i] * u[at + i] for i in range(n)) + sum(m.move[s[i], s[i + 1]] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(s)
        assert np.isclose(got, (good / total * size[at : at + n]).sum() / size[at : at + n].sum())
        at += n


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_quality_query_on_the_held_out_fold(spark):
    out = {r.doc_id: r for r in q.op1_quality(spark, str(SF)).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    held = [(out[i].predicted, y) for i, y in labels.items() if i in out and out[i].held_out and y is not None]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.9 * len(held)
