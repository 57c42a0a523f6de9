"""SentencePiece encoding and decoding through a table of distinct chunks.

A task cuts its texts into marked words, puts the ones it hasn't met into a table (each
segmented once, all new ones of a slice together) and joins ids, digits and decoded text
back by position. Nothing is shuffled or stored, so a lost task is only run again; a
worker holds a slice and a bounded table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.llm.arrow import map_slices
from marque.llm.bpe import RunCache
from marque.llm.pieces import TABLE_CHUNKS, PieceModel

_TABLES: dict[tuple[str, str], RunCache] = {}


def _table(path: str, kind: str, make: Callable[[PieceModel], Callable], limit: int) -> RunCache:
    """One model and table of chunks for a worker, file and use."""
    if (path, kind) not in _TABLES:
        model = next((t.bpe for (p, _), t in _TABLES.items() if p == path), None) or PieceModel(path)
        _TABLES[path, kind] = RunCache(model, make(model))
    _TABLES[path, kind].bpe.limit = limit
    return _TABLES[path, kind]


def _forget() -> None:
    """Empty the tables as a task ends, as workers outlive their tasks; the models stay."""
    for t in _TABLES.values():
        t.clear()


def _ids(model: PieceModel):
    return lambda ids: ids


def _digits(model: PieceModel):
    """A chunk's number of ids, the ids in decimal, and what they decode to."""
    return lambda ids: (len(ids), ",".join(map(model.id_texts.__getitem__, ids)), model.surface(ids))


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """docs with an array<int> of piece ids (empty for a null or empty text), in place of a column of that name. No shuffle."""
    docs = docs.drop(ids_col)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(model, "ids", _ids, table_chunks)
        got = table.of([table.bpe.chunks(t) if t else [] for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(chain.from_iterable(x)) for x in got], pa.list_(pa.int32()))], [*names, ids_col])

    return map_slices(docs, run, schema, by=at, done=_forget)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids (null for null ids), in place of a column of that name."""
    rows = rows.drop(text_col)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])
    at = names.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _table(model, "ids", _ids, TABLE_CHUNKS).bpe
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else own.decode(x) for x in batch.column(at).to_pylist()], pa.string())], [*names, text_col])

    return map_slices(rows, run, schema)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """id, n_tokens, and SHA-256 of the comma-joined ids and of the text decoded from them, without keeping either.

    A null text counts as empty: no ids, and the digests are of the empty string. Repeated rows give repeated
    results; other columns are not read. table_chunks: chunks that a worker keeps segmented, memory for time.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(model, "digits", _digits, table_chunks)
        n, ids, text = [], [], []
        for x in table.of([table.bpe.chunks(t) if t else [] for t in batch.column(1).to_pylist()]):
            counts, digits, parts = zip(*x, strict=True) if x else ((), (), ())
            n.append(sum(counts))
            ids.append(hashlib.sha256(",".join(digits).encode()).hexdigest())
            text.append(hashlib.sha256("".join(parts)[1:].encode()).hexdigest())  # without the leading marker's space
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    t = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(rows, run, f"id {t}, n_tokens long, ids_sha256 string, decoded_sha256 string", by=1, done=_forget)
    return out.withColumnRenamed("id", id_col)
