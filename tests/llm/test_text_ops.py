from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marque.llm import decontaminate as dc
from marque.llm.ann import nearest
from marque.llm.decontaminate import contamination, decontaminate, find_matches
from marque.llm.html_text import extract_text, main_text
from marque.llm.lm_scores import lm_scores
from marque.llm.quality import LineCRF, fit_quality, line_features, score_quality

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items):
    win = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        m = min(13, len(w))
        for j in range(len(w) - m + 1) if w else ():
            win[tuple(w[j : j + m])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, names = WORD.findall((t or "").translate(LOW)), set(), set()
        for m in {len(k) for k in win}:
            for j in range(len(w) - m + 1):
                if (k := tuple(w[j : j + m])) in win:
                    hit |= set(range(j, j + m))
                    names |= win[k]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [16_000_000, 400])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rnd = random.Random(4)
    vocab = ["the", "of", "Ünï", "x1", "B", "c", "d'e"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 12, 13, 14, 30])))) for i in range(20)] + [(20, ""), (21, None), (22, "?!"), (23, "the of"), (24, "the of")]
    docs = [(i, " ".join(rnd.choices([*vocab, "zz"], k=rnd.randint(0, 60)))) for i in range(40)]
    docs += [(40, items[5][1]), (41, "zz " * 700 + items[6][1] + " zz"), (42, None), (43, ""), (44, (items[7][1] + "! ").upper() * 2)]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b).collect()}
    want = brute_contamination(docs, items)
    assert got == want
    kept = sorted(r.doc_id for r in decontaminate(d, b).collect())
    assert kept == sorted(i for i, r in want.items() if not r[4]) and decontaminate(d, b).columns == d.columns


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"a b {item} c {' '.join(item.split()[3:18])}")], "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (None, item)], "item_id long, text string")
    (r,) = find_matches(d, b).collect()
    assert sorted((m.start, m.item, m.item_start, m.length) for m in r.matches) == [(2, "9", 0, 20), (23, "9", 3, 15)]
    assert find_matches(d, b.where("false")).first().matches == []
    assert find_matches(d.where("false"), b).count() == 0


def test_lm_scores_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["a", "B", "b", "c", "d", "é"], k=rnd.randint(0, 40))) for _ in range(60)] + ["", None, "hapax", "the\tthe  the"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, score int").repartition(3)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for t in [*texts, texts[0]]]
    u, b = collections.Counter(), collections.Counter()
    for w in words:
        u.update(w)
        b.update(zip(w, w[1:], strict=False))
    n = sum(u.values())
    got = {r.doc_id: r for r in lm_scores(df).collect()}
    for i, w in enumerate(words):
        s = seen = 0
        for j, x in enumerate(w):
            if j and b[w[j - 1], x] >= 2:
                s, seen = s + math.log(b[w[j - 1], x] / u[w[j - 1]]), seen + 1
            else:
                s += math.log(u[x] / n) + (math.log(0.4) if j else 0)
        assert (got[i].n_tokens, got[i].n_seen) == (len(w), seen) and abs(got[i].score - s) < 1e-9
    assert lm_scores(df.where("false")).count() == 0


def test_nearest_recall_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]  # more copies than k
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    bad = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [float("inf"), *[1.0] * 15]), (604, [None, *[1.0] * 15]), (605, []), (606, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, "z") for i, v in bad], "vec_id long, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = np.zeros(600)
        for j in range(16):
            s += x[q].astype(np.float64)[j] * x[:, j].astype(np.float64)
        order = [i for i in np.lexsort((np.arange(600), -s)).tolist() if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v == s[i] for _, i, v in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits >= 0.99 * 20 * len(got)
    assert [i for _, i, _ in got[100]][:3] == [101, 102, 103]
    assert nearest(df.where("false"), df.where("false")).count() == 0
    assert nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_nearest_recall_in_blocks_that_the_quantiser_prunes(spark):
    """100,000 rows in production blocks, so that each reranks about one in a hundred; recall against brute force."""
    n, d = 100_000, 32
    draw = lambda j: sum(((F.xxhash64("id", F.lit(j), F.lit(i)) % 10_000) / 10_000 for i in range(3)), F.lit(0.0))
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[draw(j).cast("float") for j in range(d)]).alias("embedding")).cache()
    rows = df.orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(np.float64)
    got = nearest(df, df.where("vec_id % 2000 = 0"), k=20).toPandas()
    hits = 0
    for q in range(0, n, 2000):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*np.argsort(-s)[:20].tolist()} & {*got[got.query_id == q].vec_id.tolist()})
    assert len(got) == 50 * 20 and hits >= 0.9 * 50 * 20
    assert nearest(df.where("vec_id < 3000"), df.where("vec_id = 7"), k=500).count() == 500


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p><b>First  para&#8211;graph<br>goes on<p>Second</p><aside>Aside</aside><form>Form</form>
<div class="share-bar">Share</div><p>Third &lt;b&gt;</p><section id="comments"><p>A reader says</p></section></article><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\n\nFirst para–graph goes on\n\nSecond\n\nThird <b>"
    long = "A sentence that is long enough to be text of the page, and goes on for a while. "
    assert main_text(f"<ul><li><a>Home</a></li></ul><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div class=sidebar>{long}</div>") == f"{long.strip()}\n\nShort.\n\n{long.strip()}"
    assert main_text(None) == main_text("") == main_text("<p>  </p>") == main_text("<script>x") == ""
    assert main_text("a < b") == "a < b" and main_text("<p>cut <scr") == "cut"
    assert main_text("<nav>open<article><p>Text</p>") == "Text"


def test_extract_text_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 2), (2, None, None, 3), (2, None, None, 3)], "page_id long, url string, html string, n_chars int")
    got = extract_text(df).collect()
    assert sorted((r.page_id, r.n_chars, len(r.text)) for r in got) == [(1, len(main_text(PAGE)), len(main_text(PAGE))), (2, 0, 0), (2, 0, 0)]
    assert extract_text(df.where("false")).count() == 0


def quality_rows(n, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and"]
    out = []
    for i in range(n):
        good = i % 2
        lines = []
        for _ in range(rnd.randint(2, 8)):
            w = rnd.choices(words, k=rnd.randint(4, 20))
            lines.append(" ".join(w).capitalize() + "." if good or rnd.random() < 0.3 else rnd.choice([" ".join(x + "***" for x in w), "!! ".join(w).upper(), " | ".join(w), (w[0] + " ") * 20]))
        out.append((i, "\n".join(lines), good))
    return out


def test_quality_learns_and_generalises(spark):
    rows = quality_rows(400, 7)
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (902, " \n\n", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert sum((out[i] >= 0.5) == bool(y) for i, _, y in rows[200:]) >= 190
    assert out[900] == out[901] == out[902] and all(0 <= v <= 1 for v in out.values())
    none = fit_quality(docs, labels.where("false"))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.where("false"), none).count() == 0


def test_marginals_equal_enumeration():
    x, _, counts = line_features([b"Aa bb.\nXX!! YY\nfoo | bar", b"one line", b""])
    assert counts.tolist() == [3, 1, 0]
    rnd = np.random.default_rng(8)
    m = LineCRF.zero()
    for k in ("own", "before", "after", "bias", "move"):
        setattr(m, k, rnd.normal(size=getattr(m, k).shape))
    u = m.potentials(x, counts)
    p, pairs = m.marginals(u, counts)
    states = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    w = np.array([math.exp(sum(s[i] * u[i] for i in range(3)) + m.move[s[0], s[1]] + m.move[s[1], s[2]]) for s in states])
    w /= w.sum()
    want = [sum(v for v, s in zip(w, states, strict=True) if s[i]) for i in range(3)]
    assert np.allclose(p[:3], want) and np.isclose(p[3], 1 / (1 + math.exp(-u[3])))
    assert np.isclose(pairs.sum(), 2) and np.isclose(pairs[1, 1], sum(v * ((s[0] & s[1]) + (s[1] & s[2])) for v, s in zip(w, states, strict=True)))
