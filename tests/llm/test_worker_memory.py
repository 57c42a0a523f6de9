"""What Python workers keep when their task has ended."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from marque.llm.decontaminate import contamination
from marque.llm.shared import cut, ship


def test_workers_drop_the_vocabulary_after_the_tokens_stage(spark):
    def held(batches):
        from marque.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(bpe._LOADED)], pa.int32())})

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(8)
    first, again = (sorted(cut(corpus_pipeline.tokens(spark, docs, "")).collect()) for _ in range(2))
    assert first == again and all(r["n_tokens"] > 0 for r in first)
    left = spark.range(400).repartition(8).mapInArrow(held, "n int").collect()
    assert len(left) >= 8 and max(r["n"] for r in left) == 0


def test_decontamination_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    plan = contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_packed_rows_come_to_workers_in_small_batches(spark):
    """Of 40 rows of a megabyte no batch holds more than a few."""

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    ship(spark)
    rows = spark.range(40).repartition(1).selectExpr("cast(repeat('x', 1000000) as binary) as data")
    got = [r.n for r in rows.mapInArrow(held, "n long").collect()]
    assert sum(got) >= 40_000_000 and max(got) <= 6_000_000
