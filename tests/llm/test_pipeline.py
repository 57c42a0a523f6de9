from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marque.llm import queries as q

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "si", "to", "ve") for c in ("", "n", "s")]
    line = lambda: " ".join(rnd.choices(vocab, k=rnd.randint(9, 16))).capitalize() + "."
    clean = [(i, "\n".join(line() for _ in range(rnd.randint(4, 7)))) for i in range(120)]
    junk = [(200 + i, "\n".join(rnd.choice([" ".join(w + "###" for w in rnd.choices(vocab, k=12)), "!! ".join(rnd.choices(vocab, k=12)).upper()]) for _ in range(4))) for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=20))) for i in range(3)]
    bad = [(300 + i, f"{line()} {t}") for i, (_, t) in enumerate(items)]
    exact = [(400, clean[0][1]), (401, clean[0][1]), (402, clean[1][1])]
    near = [(410, clean[2][1].replace("\n", " "))]
    odd = [(500, None), (501, ""), (502, "Short one.")]
    docs = clean + junk + bad + exact + near + odd
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs


def test_stages(spark, corpus):
    d, docs = corpus
    text = dict(docs)
    now = q.table(spark, d, "documents")
    columns = now.columns
    kept = {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, d)
        if name != "tokens":
            assert now.columns == columns
            now = cp.cut(now)
        kept[name] = {r.doc_id for r in now.collect()}
    clean = set(range(120))
    assert clean <= kept["quality"] and not kept["quality"] & set(range(200, 260))
    # Copies lose every line to the first one, and go.
    assert not kept["line_dedup"] & {400, 401, 402} and clean <= kept["line_dedup"]
    # The same words in one line: no duplicate line, but the same shingles.
    assert 410 in kept["line_dedup"] and 410 not in kept["near_duplicates"] and clean <= kept["near_duplicates"]
    assert {300, 301, 302} <= kept["near_duplicates"] and not kept["decontamination"] & {300, 301, 302}
    assert clean <= kept["decontamination"] == kept["tokens"]
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(q.word_bpe())
    assert {r.doc_id: r.n_tokens for r in now.where("doc_id < 120").collect()} == {i: len(tok.encode(text[i], add_special_tokens=False).ids) for i in clean}


def test_run_is_the_stages(spark, corpus):
    out = cp.run(spark, corpus[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() >= 120 and cp.ORACLE_SQL is None


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_equal_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = q.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_every_query_runs_on_the_small_tables(spark):
    for name, f in q.queries().items():
        df = f(spark, str(SF))
        assert df.agg(F.count("*")).first()[0] > 0, name
