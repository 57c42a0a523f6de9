"""The corpus pipeline: STAGES, each on all that its predecessor kept, and run().

All stages but the last return the columns of documents; n_chars follows the text. SQL
can't express the classifier, so ORACLE_SQL is None and tests hold the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.llm.bpe_codec import codec_digests
from marque.llm.decontaminate import decontaminate
from marque.llm.line_dedup import QUERY_SHINGLE, dedup_lines
from marque.llm.ngram_join import near_copies
from marque.llm.quality import fit_quality, score_quality
from marque.llm.queries import held_out, table, word_bpe
from marque.llm.shared import cut, ship, text_key

#: Runs that the last stage's workers keep: fewer than the operator's default, as the executors are full by then.
CACHE_RUNS = 60_000
#: A document goes when its quality score is below this.
MIN_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF accepts. It learns from the labelled rows of this stage's input outside the held-out fold.

    A document without text scores the prior, and so stays where most labels are good.
    """
    ship(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, model, score_col="_score").where(F.col("_score") >= MIN_QUALITY).drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each fuzzy line once in the corpus. A document that lost lines and has none left but blank ones goes: what it held stays elsewhere."""
    out = dedup_lines(docs, shingle=QUERY_SHINGLE, short_lines=True)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id (null is least), of each component of the n-gram Jaccard join.

    Rows that repeat an id and text count as one and stay or go together; an id that repeats with unlike texts
    joins nothing. Null, empty and blank texts stay.
    """
    gone = cut(near_copies(docs))
    if gone.count() * 24 <= 16_000_000:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["id"]) & (text_key(docs, "text") == gone["key"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage beyond the contract's share. Null and empty texts stay, as do all where the benchmark is empty."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digests of each document that is left; a null or empty text has none."""
    return codec_digests(docs, word_bpe(), cache_runs=CACHE_RUNS, keep=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
