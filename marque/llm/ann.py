"""Maximum inner product search by score-aware (anisotropic) quantisation.

Codebooks of 16 centroids (four bits) for subspaces of two dimensions are fitted on a
bounded sample with a loss that weighs the residual parallel to the vector ``eta`` times the
orthogonal one, as only the parallel part moves large inner products. Every row is
encoded. Rows are dealt to blocks of bounded size by a hash of their id; each block holds
its codes and vectors while the query vectors stream past in batches. A batch scans the
codes through lookup tables (two four-bit codes a byte, so one 256-entry table for each
pair of subspaces), and the best of each block are reranked by their exact inner products.

Equal vectors of a block are scanned once: of them only the ``k + 1`` least ids can be among
the k nearest of any query, so a vector that very many rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marque.llm.arrow import tidy


SUB = 2
CENTRES = 16
#: Rows that the codebooks are fitted on, at most; rows of a block; queries of a batch.
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 100_000
QUERY_BATCH = 256
#: Distinct vectors of a block that are reranked for a query: so many for each neighbour sought, and this many at least.
RERANK_EACH, RERANK = 6, 120


@dataclass
class Codebooks:
    centres: np.ndarray  # (subspaces, CENTRES, SUB)
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Codebooks:
        """x: rows. threshold: share of the norm above which an inner product matters."""
        d = x.shape[1]
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        x = _split(x)
        n, subs, _ = x.shape
        pick = np.random.default_rng(seed).choice(n, CENTRES, replace=n < CENTRES)
        out = cls(np.ascontiguousarray(x[pick].transpose(1, 0, 2)), eta)
        norm = np.sqrt((x**2).sum((1, 2)))
        u = x / norm[:, None, None]
        for _ in range(rounds):
            code = out.encode(x.reshape(n, -1))
            r = x - out.centres[np.arange(subs), code]
            par = (r * u).sum(2)
            for s in range(subs):  # weighted least squares for the centres of one subspace, the others held
                other = par.sum(1) - par[:, s]
                w = eta - 1
                a = np.eye(SUB) + w * u[:, s, :, None] * u[:, s, None, :]
                b = (a @ x[:, s, :, None])[:, :, 0] + w * other[:, None] * u[:, s]
                for k in range(CENTRES):
                    own = code[:, s] == k
                    if own.any():
                        out.centres[s, k] = np.linalg.solve(a[own].sum(0) + 1e-9 * np.eye(SUB), b[own].sum(0))
                par[:, s] = ((x[:, s] - out.centres[s, code[:, s]]) * u[:, s]).sum(1)
        return out

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        x = _split(x)
        n, subs, _ = x.shape
        u = x / np.sqrt((x**2).sum((1, 2)))[:, None, None]
        code = np.zeros((n, subs), np.uint8)
        par = np.zeros((n, subs))
        cost, side = [], []
        for s in range(subs):
            r = x[:, s, None, :] - self.centres[s]
            cost.append((r**2).sum(2))
            side.append((r * u[:, s, None, :]).sum(2))
            code[:, s] = cost[s].argmin(1)
            par[:, s] = side[s][np.arange(n), code[:, s]]
        for _ in range(sweeps):
            for s in range(subs):
                other = par.sum(1) - par[:, s]
                code[:, s] = (cost[s] + (self.eta - 1) * (other[:, None] + side[s]) ** 2).argmin(1)
                par[:, s] = side[s][np.arange(n), code[:, s]]
        return code

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of codes adds to the inner product."""
        t = np.einsum("qsd,skd->qsk", _split(q), self.centres).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], 1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def _split(x: np.ndarray) -> np.ndarray:
    pad = -x.shape[1] % SUB
    x = np.pad(x, ((0, 0), (0, pad))) if pad else x
    return x.reshape(len(x), -1, SUB).astype(np.float64)


def _packed(code: np.ndarray) -> np.ndarray:
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros_like(code[:, :1])], 1)
    return code[:, ::2] * np.uint8(CENTRES) + code[:, 1::2]


class Block:
    """Rows of a block: distinct vectors with their codes, and the ids of each."""

    def __init__(self, books: Codebooks, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + x.dtype.type(0))  # -0.0 becomes 0.0
        _, first, which = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.x = x[first].astype(np.float64)
        by = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(begin, begin[1:], strict=False)]
        self.size = np.array([len(i) for i in self.ids])
        self.codes = np.concatenate([_packed(books.encode(self.x[i : i + 8192])) for i in range(0, len(self.x), 8192)])
        self.books, self.k = books, k

    def search(self, qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the block's k best of each query."""
        table = self.books.tables(q)
        approx = np.zeros((len(q), len(self.x)), np.float32)
        for j in range(table.shape[1]):
            approx += np.take(table[:, j], self.codes[:, j], axis=1)
        m = min(max(RERANK, RERANK_EACH * self.k), len(self.x))
        top = np.argpartition(-approx, m - 1, axis=1)[:, :m] if m < len(self.x) else np.tile(np.arange(m), (len(q), 1))
        exact = np.zeros(top.shape)
        for j in range(q.shape[1]):  # one order of summation, so that equal vectors tie
            exact += q[:, j, None] * self.x[top, j]
        out = []
        for i in range(len(q)):
            n = self.size[top[i]]
            ids, score = np.concatenate([self.ids[v] for v in top[i]]), np.repeat(exact[i], n)
            other = ids != qid[i]
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[: self.k]
            out.append((np.full(len(best), qid[i]), ids[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of vectors of largest inner product for each query: query_id, rank, vec_id, score.

    A query's own id is no candidate; ties go to the smaller id. Vectors that are null, zero,
    or hold a null or non-finite component take no part, nor do those of another length
    than most; repeated rows of one id count once for each row. Ids are integers; rows without one are
    left out. Other columns are not read. Every row is indexed; only the codebooks come from a sample.
    """
    spark = vectors.sparkSession
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    result = "query_id long, rank int, vec_id long, score double"
    rows, asked = valid(vectors), valid(queries)
    counts = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not counts:
        return spark.createDataFrame([], result)
    dim, n = counts[0]["d"], counts[0]["count"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE_ROWS) if n > SAMPLE_ROWS else rows
    held = spark.sparkContext.broadcast(Codebooks.fit(np.array([r.v for r in sample.select("v").toLocalIterator()])))
    blocks = max(8, -(-n // BLOCK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, QUERY_BATCH):
                s = b.slice(i, QUERY_BATCH)
                v = s.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([s.column(0).to_numpy().tobytes()]), pa.array([v.tobytes()])], ["ids", "vecs"])

    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    packed = asked.mapInArrow(tidy(pack), "ids binary, vecs binary").select(each.alias("block"), F.lit(1).alias("kind"), "ids", "vecs")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
                ids = b.column(0).to_numpy()
                own = b.column(2).to_numpy()
                for k in np.unique(own):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([ids[own == k].tobytes()]), pa.array([v[own == k].tobytes()])], ["block", "kind", "ids", "vecs"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).mapInArrow(tidy(lay), "block int, kind int, ids binary, vecs binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, block = None, [], [], None
        for b in batches:
            for own, kind, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != at:
                    at, ids, vecs, block = own, [], [], None
                i, v = np.frombuffer(i, np.int64), np.frombuffer(v, np.float64).reshape(-1, dim)
                if kind == 0:
                    ids.append(i)
                    vecs.append(v)
                elif ids:
                    if block is None:
                        block = Block(held.value, np.concatenate(ids), np.concatenate(vecs), k)
                        vecs = []
                    for j in range(0, len(i), 64):
                        got = block.search(i[j : j + 64], v[j : j + 64])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    found = dealt.unionByName(packed).repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(tidy(scan), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
