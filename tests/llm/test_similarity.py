from __future__ import annotations

import hashlib
import random
import re

import pytest

from marque.llm import line_dedup, ngram_join
from marque.llm.components import connected_components
from marque.llm.line_dedup import dedup_lines
from marque.llm.ngram_join import jaccard_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed, groups=12, size=9, words=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    common = rnd.choices(vocab, k=30)
    out = []
    for _ in range(groups):
        base = rnd.choices(vocab, k=words)
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            out.append(" ".join(t if rnd.random() < 0.7 else t + common))
    return out


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, components(len(sets), links), strict=True)]


@pytest.mark.parametrize("passes,block,few", [(2, 768, 0), (0, 8, 0), (1, 8, 0), (2, 8, 3000)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, passes, block, few):
    monkeypatch.setattr(ngram_join, "PASSES", passes)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", block)
    texts = near_copies(passes) + ["", None, " \n", "One", "one", "ONE two", "one two", "a b c d e", "a  b\tc d E", "é É"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_ngram_join_without_rows_and_with_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(3, 3), (7, 3), (7, 3), (9, 9)]
    assert jaccard_components(df.where("false")).count() == 0
    assert [r.component_id for r in jaccard_components(df.where("text is null")).collect()] == [9]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (41, 40), (1, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(42), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least=40, percent=80, k=9):
    lines = [(i, n, x.translate(LOW)) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= least]
    sets = [{x[j : j + k] for j in range(len(x) - k + 1)} for _, _, x in lines]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(lines), links)
    return {(i, n) for c, (i, n, _) in zip(range(len(lines)), lines, strict=True) if comp[c] != c}


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choices([f"word{i}" for i in range(300)], k=rnd.randint(8, 20))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rnd.randint(1, 5)):
            x = rnd.choice(pool)
            own.append(x if rnd.random() < 0.5 else x.replace(x.split()[2], "zzz", 1) if rnd.random() < 0.5 else x.upper())
        rows.append((i, "\n".join([*own, "short"])))
    rows += [(60, None), (61, ""), (62, rows[0][1]), (63, "é" * 50), (64, "é" * 50), (65, "x\n\ny")]
    gone = brute_lines(rows)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    out = {r.doc_id: r for r in dedup_lines(df).collect()}
    for i, t in rows:
        if t is None:
            assert out[i].text is None and out[i].n_lines == 0
            continue
        kept = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        assert out[i].text == "\n".join(kept), i
        assert (out[i].n_lines, out[i].n_removed, out[i].key) == (len(t.split("\n")), len(t.split("\n")) - len(kept), "k")
        assert out[i].n_long_kept == sum(len(x) >= 40 for x in kept)


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a" * 60), (1, "a" * 60), (2, "a" * 60 + "\nb")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(df).collect())
    assert got == [(1, "a" * 60), (1, "a" * 60), (2, "b")]
    assert dedup_lines(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(df, min_chars=line_dedup.SHINGLE - 1)


def test_hashes_are_stable():
    from marque.llm.hashing import BLANK, hashed_words, lower_ascii

    h, n = hashed_words([b"Aa bB", b"", b"aa"], lower_ascii(), BLANK)
    assert n.tolist() == [2, 0, 1] and h[0] == h[2] and h[0] != h[1]
    assert hashlib.sha256(h.tobytes()).hexdigest() == hashlib.sha256(hashed_words([b"aa bb aa"], lower_ascii(), BLANK)[0].tobytes()).hexdigest()
