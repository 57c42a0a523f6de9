"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.llm.arrow import map_slices
from marque.llm.bpe import CACHE_RUNS, WordBpe, forget, loaded, unload


def _ids(bpe: WordBpe):
    return lambda ids: ids


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array<int> of token ids (empty for a null or empty text), in place of a column of that name. No shuffle."""
    docs = docs.drop(ids_col)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = loaded(tokenizer, "ids", _ids)
        got = cache.of([cache.bpe.runs(t) if t else [] for t in batch.column(at).to_pylist()])
        ids = pa.array([[i for run in x for i in run] for x in got], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, ids_col])

    return map_slices(docs, run, schema, by=at, done=forget)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids (null for null ids), in place of a column of that name."""
    rows = rows.drop(text_col)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])
    at = names.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(tokenizer, "ids", _ids).bpe
        out = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, text_col])

    return map_slices(rows, run, schema)


def codec_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache_runs: int = CACHE_RUNS, keep: bool = True) -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the decoded text, without keeping either.

    A null text counts as empty: no ids, and the digests are of the empty string. cache_runs:
    runs of text a worker keeps encoded, memory for time; keep: whether it keeps the vocabulary when a task ends. Repeated rows give repeated results; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = loaded(tokenizer, "ids", _ids, cache_runs)
        number = cache.bpe.text_ids.__getitem__
        got = cache.of([cache.bpe.runs(t) if t else [] for t in batch.column(1).to_pylist()])
        n, ids, text = [], [], []
        for x in got:
            flat = list(chain.from_iterable(x))
            n.append(len(flat))
            ids.append(hashlib.sha256(" ".join(map(number, flat)).encode()).hexdigest())
            text.append(hashlib.sha256(cache.bpe.decode(flat).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    t = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(rows, run, f"id {t}, n_tokens long, ids_sha256 string, decoded_sha256 string", by=1, done=forget if keep else unload)
    return out.withColumnRenamed("id", id_col)
