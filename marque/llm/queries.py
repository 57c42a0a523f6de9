"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import let
from marque.llm import oracles
from marque.llm.ann import nearest
from marque.llm.bpe_codec import codec_digests
from marque.llm.decontaminate import contamination
from marque.llm.html_text import extract_text
from marque.llm.line_dedup import QUERY_SHINGLE, dedup_lines
from marque.llm.lm_scores import lm_scores
from marque.llm.ngram_join import jaccard_components
from marque.llm.periodic import run_digests
from marque.llm.piece_codec import piece_digests
from marque.llm.pii import pseudonymise
from marque.llm.quality import fit_quality, score_quality
from marque.llm.shared import ship
from marque.llm.token_counts import token_counts
from marque.llm.vector_codes import compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(spark_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; never learned from."""
    return F.crc32(F.col(spark_id).cast("string")) % 3 == 1


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"), alpha=0.4, min_count=2)
    return out.withColumn("score", F.round("score", 3))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_bpe(), limit=2048)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"), word_bpe())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), percent=80, min_chars=40, shingle=QUERY_SHINGLE, short_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a production run comes from the caller's secret store; this one is for the tests."""
    return pseudonymise(table(spark, sf_dir, "documents"), key="test-key").select("doc_id", "n_entities", "text")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), pieces())


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the ids, by crc32, the words from a place on repeat with a period, as the contract of operator 12 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    text = let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), tail)
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(repeated_tails(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_decontamination, op3_lm_scores, op4_nearest, op5_token_counts, op6_bpe_codec, op7_line_dedup, op8_html_text, op9_ngram_jaccard, op10_surrogates, op11_piece_codec, op12_periodic_runs, op13_vector_codes)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Of the others SQL expresses none: models, tokenizers, hashes with a key and HTML are tested against brute force."""
    return {"op2_decontamination": oracles.OP2, "op3_lm_scores": oracles.OP3, "op9_ngram_jaccard": oracles.OP9}
