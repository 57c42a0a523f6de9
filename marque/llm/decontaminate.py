"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of documents in a worker. Its suffix array holds the word suffixes that
could start a benchmark window: those followed by enough words of the benchmark's own
vocabulary (no other suffix can match). Suffixes are kept as fixed-width keys of their
first words and sorted; every benchmark suffix is binary-searched in every shard. Runs of
hits along a diagonal (document position minus item position) are the longest verbatim
matches, with their places.

The benchmark travels to the executors in blocks of bounded size; a larger benchmark takes
more than one pass over the documents and the hits of the passes are united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import map_slices

#: Words of a window: a fixed value of the task.
WINDOW = 13
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 16_000_000

#: A-Z lower-cased; every byte that is no word byte becomes a space. All bytes of
#: characters beyond ASCII are word bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _keys(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Sort keys of the suffixes at starts: three bytes a word, none of them 0; shorter at the document's end."""
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    x = np.where(inside, ids[np.minimum(at, len(ids) - 1)], 0)
    out = np.empty((len(starts), width, 3), np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = x // 65025 + 1, x // 255 % 255 + 1, x % 255 + 1
    out[~inside] = 0
    return out.reshape(len(starts), width * 3).view(f"S{width * 3}").ravel()


@dataclass
class Benchmark:
    """The windows of a block of items, ready for search. Word ids start at 1; 0 is any other word."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    windows: np.ndarray | None = None  # distinct window keys, sorted
    sizes: np.ndarray | None = None  # words of each window
    owners: list[np.ndarray] = field(default_factory=list)  # items with that window
    places: list[np.ndarray] = field(default_factory=list)  # where in the item
    least: int = WINDOW

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int = WINDOW) -> Benchmark:
        """items: (id as text, UTF-8 text)."""
        out = cls()
        found: dict[bytes, list[tuple[int, int]]] = {}
        size: dict[bytes, int] = {}
        for i, (_, text) in enumerate(items):
            w = words(text)
            if not w:
                continue
            ids = np.array([out.vocab.setdefault(x, len(out.vocab) + 1) for x in w], np.int64)
            m = min(window, len(w))
            out.least = min(out.least, m)
            starts = np.arange(len(w) - m + 1)
            for p, k in enumerate(_keys(ids, starts, starts + m, window).tolist()):
                found.setdefault(k, []).append((i, p))
                size[k] = m
        order = sorted(found)
        out.windows = np.array(order, f"S{window * 3}")
        out.sizes = np.array([size[k] for k in order], np.int64)
        out.owners = [np.array([i for i, _ in found[k]]) for k in order]
        out.places = [np.array([p for _, p in found[k]]) for k in order]
        return out

    def search(self, docs: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the joined documents, and windows, of all hits."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for d in docs for w in d], np.int64)
        none = np.zeros(0, np.int64)
        if not ids.size or self.windows is None or not len(self.windows):
            return none, none
        end = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
        stop = np.minimum.accumulate(np.where(ids == 0, np.arange(len(ids)), len(ids))[::-1])[::-1]  # next foreign word
        starts = np.flatnonzero(np.minimum(stop, end) - np.arange(len(ids)) >= self.least)
        if not starts.size:
            return none, none
        keys = _keys(ids, starts, end[starts], window)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys, starts = keys[order], starts[order]
        lo = np.searchsorted(keys, self.windows, "left")
        hi = np.searchsorted(keys, np.char.add(self.windows, b"\xff"), "left")  # all suffixes that begin with the window
        n = hi - lo
        w = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return starts[at], w


def _matches(bench: Benchmark, pos: np.ndarray, win: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document start, item, item start, words) of the longest verbatim matches of one document."""
    rows = sorted((int(i), int(p) - int(q), int(p), int(bench.sizes[w])) for p, w in zip(pos, win, strict=True) for i, q in zip(bench.owners[w], bench.places[w], strict=True))
    out: list[tuple[int, int, int, int]] = []
    last: tuple[int, int, int] | None = None
    for i, d, p, m in rows:
        if last == (i, d, p - 1):
            s, _, q, n = out[-1]
            out[-1] = (s, i, q, n + 1)
        else:
            out.append((p, i, p - d, m))
        last = (i, d, p)
    return out


#: What becomes of a batch of found matches, and the columns beside the id.
Then = tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str]
_FOUND = "n_words long, matches array<struct<start long, item string, item_start long, length long>>"


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], then: Then | None = None) -> DataFrame:
    """docs(row, text binary) -> row, n_words, matches(start, item, item_start, length), or what then makes of these in the same worker."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((Benchmark.build(items), [i for i, _ in items]))
    t = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bench, names = held.value
        texts = [words(x) if x else [] for x in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.r_[0, np.cumsum(sizes)]
        found: list[list[dict]] = [[] for _ in texts]
        pos, win = bench.search(texts)
        if pos.size:
            doc = np.searchsorted(base, pos, "right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d
                found[d] = [{"start": s, "item": names[i], "item_start": q, "length": n} for s, i, q, n in _matches(bench, pos[own] - base[d], win[own])]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64()), ("length", pa.int64())]))
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(found, kind)], ["id", "n_words", "matches"])
        return out if then is None else then[0](out)

    return map_slices(docs, run, f"id {t}, {_FOUND if then is None else then[1]}", by=1)


def _covered(spans: list[tuple[int, int]]) -> int:
    n = reach = 0
    for s, e in sorted(spans):
        n += max(0, e - max(s, reach))
        reach = max(reach, e)
    return n


def find_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, and the longest verbatim matches of benchmark windows.

    A match has the place of its first word in the document and in the item, the item's id
    as text, and its length in words. Null or empty texts and items have no words; items
    with a null id are left out; repeated rows of docs give repeated results (with more
    than one block of items their matches are united). Extra columns are not read.
    """
    return _found(docs, bench, id_col, text_col, item_col, item_text)


def _found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, then: Then | None = None) -> DataFrame:
    """find_matches, or what then makes of it: for one block of items in the worker that searches, as a second one a task takes its memory."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("item is not null and octet_length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    if blocks == 1:
        return _scan(rows, [(r.item, bytes(r.text)) for r in items.orderBy("item", "text").collect()], then).withColumnRenamed("id", id_col)
    rows = rows.withColumn("id", F.struct(F.col("id"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")))
    cut = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = [_scan(rows, [(r.item, bytes(r.text)) for r in items.where(cut == b).orderBy("item", "text").collect()]) for b in range(blocks)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    n = whole.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"), F.count("*").alias("n"))
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("n") / blocks).cast("int")))
    out = n.select(F.col("id.id").alias("id"), "n_words", "matches", copies.alias("copy")).drop("copy")
    if then is not None:
        out = map_slices(out, then[0], f"id {out.schema['id'].dataType.simpleString()}, {then[1]}")
    return out.withColumnRenamed("id", id_col)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """Per row of docs: n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated when it
    has hits and ``share`` times their number reaches its words.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit, n, sha = [], [], []
        for ms in batch.column(2).to_pylist():
            names = sorted({m["item"] for m in ms})
            hit.append(_covered([(m["start"], m["start"] + m["length"]) for m in ms]))
            n.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_hit", "n_items", "items_sha256"])

    out = _found(docs, bench, id_col, text_col, item_col, item_text, (run, "n_words long, n_hit long, n_items long, items_sha256 string"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """docs without the contaminated rows; each row is judged by itself, all columns are kept, nothing is shuffled
    while the benchmark fits one block."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kept = contamination(whole, bench, "row", "text", share=share).where("not contaminated")
    return kept.select("row.*")
