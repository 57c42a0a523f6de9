"""Document quality by a linear-chain conditional random field over lines.

Each line is described by binned shape features (case, symbols, separators, repeated
words, lengths) of itself, the line before and the line after; a binary chain CRF labels it
good or bad. The labels of training documents are given to all of their lines. A
document's score is the mean of its lines' forward-backward marginals, weighted by length.

Training uses a bounded sample of labelled rows (``per_class`` documents of each label,
chosen by a hash of the id); scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.llm.arrow import map_slices, slices, tidy
from marque.llm.hashing import prefix_sums, span_hash, word_spans

#: Bin edges of each feature of a line.
BINS: dict[str, tuple[float, ...]] = {
    "upper_per_letter": (0.02, 0.06, 0.15, 0.4, 0.8),
    "symbols_per_char": (0.003, 0.02, 0.06, 0.15, 0.3),
    "bars_per_word": (0.01, 0.1, 0.3, 0.7),
    "marks_per_word": (0.01, 0.1, 0.4, 0.9, 1.5),
    "repeats_per_word": (0.02, 0.1, 0.3, 0.6),
    "digits_per_char": (0.005, 0.03, 0.1, 0.3),
    "stops_per_word": (0.02, 0.06, 0.12, 0.25, 0.6),
    "chars_per_word": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0),
    "words": (1.5, 3.5, 8.5, 20.5, 60.5, 150.5),
    "other_per_char": (0.005, 0.03, 0.08, 0.2),
    "distinct_per_word": (0.3, 0.5, 0.7, 0.85),
    "joined_words": (0.01, 0.1, 0.3, 0.7),
}
NAMES = tuple(BINS)
WIDTH = [len(v) + 1 for v in BINS.values()]
SIZE = sum(WIDTH)
_FIRST = np.cumsum([0, *WIDTH[:-1]])

_C = np.arange(256)
_BLANK = np.isin(_C, [32, *range(9, 14)])
_LOWER, _UPPER, _DIGIT = (_C >= 97) & (_C <= 122), (_C >= 65) & (_C <= 90), (_C >= 48) & (_C <= 57)
_SYMBOL = np.isin(_C, list(b"#$%&*@^~=<>+\\/_{}[]`"))
_LEAD = (_C < 128) | (_C >= 192)  # first bytes of characters


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines, features) as uint8, characters of each line, lines of each text. Blank lines don't count."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stop = np.flatnonzero(b == 10)
    start = np.r_[0, stop[:-1] + 1]
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])

    def per_line(mask: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(mask, dtype=np.int32)]
        return (c[stop] - c[start]).astype(np.float64)

    full = per_line(~_BLANK[b] & _LEAD[b])
    ws, we = word_spans(b, _BLANK)
    h = span_hash(prefix_sums(b), ws, we)
    line = np.searchsorted(stop, ws)
    words = np.bincount(line, minlength=len(stop)).astype(np.float64)
    repeat = np.bincount(line[1:], (h[1:] == h[:-1]) & (line[1:] == line[:-1]), len(stop)) if len(h) else words
    key = np.unique(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(line[key], minlength=len(stop))
    tail = np.bincount(line, _SYMBOL[b[we - 1]] if len(h) else None, len(stop)) if len(h) else words
    one, w = np.maximum(full, 1), np.maximum(words, 1)
    letters = per_line(_LOWER[b]), per_line(_UPPER[b])
    values = (
        letters[1] / np.maximum(letters[0] + letters[1], 1),
        per_line(_SYMBOL[b]) / one,
        per_line(b == 124) / w,
        per_line((b == 33) | (b == 63)) / w,
        repeat / w,
        per_line(_DIGIT[b]) / one,
        per_line(np.isin(_C, list(b".,;:"))[b]) / w,
        full / w,
        words,
        per_line(b >= 192) / one,
        distinct / w,
        tail / w,
    )
    x = np.stack([np.searchsorted(e, v, "right") for e, v in zip(BINS.values(), values, strict=True)], 1).astype(np.uint8)
    keep = full > 0
    per_text = np.diff(np.r_[0, np.cumsum(keep)][np.searchsorted(start, first)])
    return x[keep], full[keep], per_text


@dataclass
class LineCRF:
    """Weights for a good line: own, previous and next line's bins; transitions; the score without lines."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray  # every line, first line, last line
    move: np.ndarray  # [from, to], 0 bad, 1 good
    prior: float

    @classmethod
    def zero(cls, prior: float = 0.5) -> LineCRF:
        return cls(np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE), np.zeros(3), np.zeros((2, 2)), prior)

    def potentials(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = x.astype(np.int64) + _FIRST
        u = self.own[at].sum(1) + self.bias[0]
        begin, end = _edges(counts)
        prev, nxt = self.before[at].sum(1), self.after[at].sum(1)
        u += np.where(begin, self.bias[1], np.r_[0.0, prev[:-1]]) + np.where(end, self.bias[2], np.r_[nxt[1:], 0.0])
        return u

    def marginals(self, u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each line is good, and the expected transitions (2, 2) summed over all chains."""
        p, pairs = np.zeros(len(u)), np.zeros((2, 2))
        begin = np.cumsum(counts) - counts
        t = np.exp(self.move - self.move.max())
        kind = np.where(counts > 0, np.ceil(np.log2(np.maximum(counts, 1))), -1)
        for k in np.unique(kind[kind >= 0]):
            docs = np.flatnonzero(kind == k)
            n, m = counts[docs], int(counts[docs].max())
            at = np.minimum(begin[docs][:, None] + np.arange(m), len(u) - 1)
            real = np.arange(m) < n[:, None]
            e = np.clip(np.where(real, u[at], 0.0), -60, 60)
            good = 1 / (1 + np.exp(-e))
            emit = np.stack([1 - good, good], 2)
            f = np.zeros((len(docs), m, 2))
            g = np.ones((len(docs), m, 2))
            a = emit[:, 0]
            f[:, 0] = a / a.sum(1, keepdims=True)
            for i in range(1, m):
                a = (f[:, i - 1] @ t) * emit[:, i]
                f[:, i] = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
            for i in range(m - 2, -1, -1):
                z = (emit[:, i + 1] * g[:, i + 1]) @ t.T
                z /= np.maximum(z.sum(1, keepdims=True), 1e-300)
                g[:, i] = np.where(real[:, i + 1, None], z, 1.0)
            q = f * g
            q /= np.maximum(q.sum(2, keepdims=True), 1e-300)
            p[at[real]] = q[:, :, 1][real]
            if m > 1:
                x = f[:, :-1, :, None] * t * (emit * g)[:, 1:, None, :]
                x /= np.maximum(x.sum((2, 3), keepdims=True), 1e-300)
                pairs += x[real[:, 1:]].sum(0)
        return p, pairs

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, size, counts = line_features(texts)
        out = np.full(len(texts), self.prior)
        if not len(x):
            return out
        p, _ = self.marginals(self.potentials(x, counts), counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        weight = np.bincount(doc, size, len(texts))
        some = weight > 0
        out[some] = np.bincount(doc, size * p, len(texts))[some] / weight[some]
        return np.clip(out, 0.0, 1.0)

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, prior: float, steps: int = 80, rate: float = 0.08, ridge: float = 2e-3) -> LineCRF:
        """Adam on the conditional log-likelihood per line; each chain weighs its class's share alike."""
        model = cls.zero(prior)
        if not len(x):
            return model
        y = np.repeat(labels, counts).astype(np.float64)
        at = x.astype(np.int64) + _FIRST
        begin, end = _edges(counts)
        follow = ~begin[1:]
        seen = np.array([[((y[:-1] == a) & (y[1:] == b) & follow).sum() for b in (0, 1)] for a in (0, 1)], np.float64)
        names = ("own", "before", "after", "bias", "move")
        m1 = {k: np.zeros_like(getattr(model, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(model, k)) for k in names}
        for step in range(1, steps + 1):
            p, pairs = model.marginals(model.potentials(x, counts), counts)
            d = (y - p) / len(y)
            tally = lambda v, rows: np.bincount(at[rows].ravel(), np.repeat(v, at.shape[1]), SIZE)
            grad = {
                "own": tally(d, slice(None)),
                "before": tally(d[1:][follow], np.flatnonzero(follow)),
                "after": tally(d[:-1][follow], np.flatnonzero(follow) + 1),
                "bias": np.array([d.sum(), d[begin].sum(), d[end].sum()]),
                "move": (seen - pairs) / len(y),
            }
            for k in names:
                w = getattr(model, k)
                g = grad[k] - ridge * w / 10
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                setattr(model, k, w + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8))
        return model


def _edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(counts.sum())
    begin, end = np.zeros(n, bool), np.zeros(n, bool)
    some = counts[counts > 0]
    stop = np.cumsum(some)
    begin[stop - some], end[stop - 1] = True, True
    return begin, end


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1200) -> LineCRF:
    """Fit on at most per_class labelled documents of each label.

    A label is 0 or 1; null ids, null labels and ids with conflicting labels are left out. Of rows that
    repeat an id one counts, that of the least text.
    Without any labelled document every score is 0.5.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("hi")).where("y = hi").select("id", "y")
    share = one.agg(F.avg("y")).first()[0]
    if share is None:
        return LineCRF.zero()
    rank = F.xxhash64("id", F.lit("sample"))
    some = [one.where(F.col("y") == v).orderBy(rank, "id").limit(per_class) for v in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class ids at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(picked, "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                texts = [t or b"" for t in b.column(2).to_pylist()]
                x, _, counts = line_features(texts)
                cuts = np.cumsum(counts)[:-1]
                data = [p.tobytes() for p in np.split(x, cuts)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["id", "y", "x"])

    t = docs.schema[id_col].dataType.simpleString()
    k = labels.schema[label_col].dataType.simpleString()
    got = sorted(rows.mapInArrow(tidy(run), f"id {t}, y {k}, x binary").collect(), key=lambda r: (str(r.id), bytes(r.x)))
    xs = [np.frombuffer(r.x, np.uint8).reshape(-1, len(NAMES)) for r in got]
    if not xs:
        return LineCRF.zero()
    return LineCRF.fit(np.concatenate(xs), np.array([len(v) for v in xs]), np.array([int(r.y) for r in got]), float(share))


def score_quality(docs: DataFrame, model: LineCRF, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the quality score of each row (0 to 1). A text without a non-blank line, or null, scores the prior.

    All columns pass through (one named score_col is replaced); repeated rows score alike.
    """
    docs = docs.select(*[c for c in docs.columns if c != score_col])
    names = docs.columns
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = held.value.scores([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*names, score_col])

    return map_slices(docs, run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]), by=at)
