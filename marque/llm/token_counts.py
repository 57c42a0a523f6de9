"""Token counts: rank-synchronous merging of ragged arrays, counting the surviving symbols."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import map_slices
from marque.llm.bpe import WordBpe, forget, loaded


def _count(bpe: WordBpe):
    return len


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    tokenizer: path of the vocabulary file, present on every executor. A null text counts
    as empty (0 bytes, 0 tokens); repeated rows give repeated results; other columns are
    not read. One pass without a shuffle; a worker holds a slice and a bounded cache.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = loaded(tokenizer, "count", _count)
        texts = batch.column(1).to_pylist()
        got = cache.of([cache.bpe.runs(t) if t else [] for t in texts])
        n = pa.array([sum(x) for x in got], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    t = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_slices(rows, count, f"id {t}, n_bytes long, n_tokens long", by=1, done=forget)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
