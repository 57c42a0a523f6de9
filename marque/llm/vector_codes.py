"""Vector compression: integer product quantisation, entries found by partial-distance search.

Components become integers, so every distance, sum and mean is exact and the result doesn't
depend on how rows are dealt. A round of fitting is one pass: a task adds up, for each part
and entry, the parts that it assigns, and sends a row for each; 128 rows come to the
driver. Nothing of the vectors is shuffled or held.

The search takes a codebook's dimensions in descending variance. The entry that is
nearest in the first of them gives a complete distance to beat; accumulated distances of the
others are masked out dimension by dimension once they strictly exceed the best complete one, which
is lowered halfway by completing the leader. Equal distances survive, and go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import tidy
from marque.llm.shared import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers are held to this on either side, so that no sum of squares overflows.
BOUND = 2**27
#: Rows handled at once.
SLICE = 8192
#: Label sums up to this many are broadcast.
FEW_LABELS = 100_000


def partial_distance(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of book for each row of x; all are int64."""
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    ahead = (x[:, :1] - book[None, :, 0]) ** 2
    best = ((x - book[ahead.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(ahead <= best[:, None])
    sums = ahead[row, entry]
    for d in range(1, dims):
        sums += (x[row, d] - book[entry, d]) ** 2
        if d == dims // 2:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.repeat(np.minimum.reduceat(sums, first), np.diff(np.r_[first, row.size]))
            lead = np.flatnonzero(sums == least)
            rest = ((x[row[lead], d + 1 :] - book[entry[lead], d + 1 :]) ** 2).sum(1)
            np.minimum.at(best, row[lead], sums[lead] + rest)
        stay = sums <= best[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, first)
    hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[first, row.size])))
    hit = hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]]  # pairs are in order of row and entry
    return entry[hit], least


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of floor(SCALE * x); shorter vectors end in zeros."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = np.clip(flat, -BOUND, BOUND).astype(np.int64)
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = flat
    return out


def _parts(batches: Iterator[pa.RecordBatch], at: int, dim: int, parts: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows, and their integers cut into parts."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            s = b.slice(i, SLICE)
            yield s, np.split(_integers(s.column(at), dim), parts, axis=1)


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, width) after one round over all rows (id, label, v)."""
    parts, entries, width = books.shape
    names = [f"s{d}" for d in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, cuts in _parts(batches, 2, parts * width, parts):
            for p, x in enumerate(cuts):
                code, _ = partial_distance(x, books[p])
                n[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, x)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), *(pa.array(sums[part, entry, d]) for d in range(width))], ["part", "entry", "n", *names])

    own = rows.mapInArrow(tidy(add), ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    total = own.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    books = books.copy()
    for r in total.collect():  # parts times entries at most
        books[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return books


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col).cast("array<double>")
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    return vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integer codebooks (parts, entries, width) fitted on all vectors that are neither null nor hold null or non-finite components.

    They begin as the parts of the vectors of the smallest ids (of equal ids the smallest vector; null ids last; fewer
    vectors give fewer entries). Each round assigns every part to the nearest entry and moves entries to the floor of their
    parts' mean; unused ones stay. Vectors shorter than the longest, or than a multiple of parts, count as ending in
    zeros; integers beyond 2**27 (components of 32,768) count as that. Without vectors the result is empty.
    """
    rows = _kept(vectors, id_col, vec_col, None)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 0), np.int64)
    dim = -(-longest // parts) * parts
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = _integers(pa.array([r.v for r in seeds], pa.list_(pa.float64())), dim)
    books = np.ascontiguousarray(start.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _improved(rows, books)
    return books


def encode_vectors(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """id, label (as "label"), code (two hex digits a part) and error (squared distances summed) of every vector that can be coded."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = _kept(vectors, id_col, vec_col, label_col)
    kinds = dict(rows.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, cuts in _parts(batches, 2, parts * width, parts):
            got = [partial_distance(x, books[p]) for p, x in enumerate(cuts)]
            codes = np.stack([c for c, _ in got], axis=1).astype(np.uint8)
            text = codes.tobytes().hex()
            wide = 2 * parts
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string()), pa.array(sum(d for _, d in got))], ["id", "label", "code", "error"])

    out = rows.mapInArrow(tidy(code), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return out.withColumnRenamed("id", id_col)


def decode_vectors(codes: DataFrame, books: np.ndarray, code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """codes with the vectors that they stand for (array<double>; null for a null code), in place of a column of that name."""
    parts, _, width = books.shape
    held = F.lit([[float(x) / SCALE for x in e] for b in books.tolist() for e in b] if books.size else [[0.0]])
    entry = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    own = F.concat(*[F.get(held, entry(p) + p * books.shape[1]) for p in range(parts)])
    return codes.drop(out_col).withColumn(out_col, F.when(F.col(code_col).isNotNull(), own))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256 of every vector that can be coded.

    Fits on all of them, see fit_codebooks. Rows without a vector, or with null or non-finite components, are left out;
    repeated rows are coded each. The codes are written once; sums of a label come back by a join that broadcasts
    them while they are few, and that is split like any skewed join otherwise. Other columns are not read.
    """
    books = fit_codebooks(vectors, id_col, vec_col, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut(encode_vectors(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), F.col(label_col).alias("_label")), books, "_id", "_v", "_label"))
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
