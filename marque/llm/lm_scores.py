"""Stupid-backoff language-model scores of documents by bigram and unigram count tables.

S(w | h) is c(h w) / c(h) where the bigram is in the table, else alpha * c(w) / N. The
tables count the whole corpus that is scored; a bigram enters with ``min_count``
occurrences, as one seen only in the text at hand says nothing about it.

All is relational, on packed rows (``dealing``). Documents are taken in parts. A part's distinct
bigrams and distinct words, with their numbers in it, go to the blocks of their hashes, and the
part itself to its home. A block sums what all parts send: its share of the count tables. It
joins them to what was asked, and sends the counts home, where the documents are summed.

As a part asks once for what it holds many times, a frequent word or bigram is no more than
an entry a part. Words and bigrams are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import slices, tidy
from marque.llm.dealing import LOCAL, SCHEMA, Deal, Packed, Row, batched, grouped, united
from marque.llm.hashing import BLANK, hashed_words, lower_ascii, mix
from marque.llm.shared import cut, text_bytes

#: Text bytes for each block, and text bytes and documents of a part.
BLOCK_BYTES = 12_000_000
PART_BYTES = 6_000_000
PART_DOCS = 60_000

#: Kinds of rows: documents with their words; what a part asks of bigrams and of words; their counts.
_HOME, _PAIRS, _WORDS, _PAIR_COUNTS, _WORD_COUNTS = range(5)
#: What stands before a document's first word; a word's own hash of 0 becomes 1.
_BEGIN = np.uint64(0)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Batches = Iterator[pa.RecordBatch]


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    h, size = hashed_words([t or b"" for t in texts], lower_ascii(), BLANK)
    return np.maximum(h, np.uint64(1)), size


def _bigrams(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bigrams end in a sequence of words, and their hashes."""
    at = np.flatnonzero((w[1:] != _BEGIN) & (w[:-1] != _BEGIN)) + 1
    return at, mix(mix(w[at - 1]) * _SPREAD + w[at])


def _place(deal: Deal):
    """The blocks of entries of a kind."""
    return lambda kind, e: deal.place(e.cols[0]) if kind in (_PAIRS, _WORDS) else deal.homes(e.who[e.of])


def _explode(rows: DataFrame, deal: Deal) -> DataFrame:
    """(id as text, text binary) -> what parts ask for, and the parts."""

    def sent(part: int, ids: list[str | None], size: np.ndarray, w: np.ndarray) -> Iterator[Row]:
        who = np.uint64(part << int(LOCAL)) + np.arange(len(size), dtype=np.uint64)
        w = np.insert(w, np.cumsum(size) - size, _BEGIN)
        home = Packed(who, np.repeat(np.arange(len(size)), size + 1), [w], (), np.array([*ids, None], object)[:-1])
        yield from deal.rows(_HOME, part, deal.homes(who[home.of]), home)
        for kind, h in ((_PAIRS, _bigrams(w)[1]), (_WORDS, w[w != _BEGIN])):
            h, n = np.unique(h, return_counts=True)
            asked = Packed(who[:1], np.zeros(len(h), np.int64), [h, n, np.arange(len(h))])
            yield from deal.rows(kind, part, deal.place(h), asked)

    def made(batches: Batches) -> Iterator[Row]:
        part = TaskContext.get().partitionId() << 24
        ids: list[str | None] = []
        sizes: list[np.ndarray] = []
        words: list[np.ndarray] = []
        bulk = 0
        for batch in batches:
            for some in slices(batch, pc.binary_length(batch.column(1)).to_pylist()):
                texts = some.column(1).to_pylist()
                w, size = _words(texts)
                ids += some.column(0).to_pylist()
                sizes.append(size)
                words.append(w)
                bulk += sum(len(t or b"") for t in texts)
                if bulk > PART_BYTES or len(ids) > PART_DOCS:
                    yield from sent(part, ids, np.concatenate(sizes), np.concatenate(words))
                    part, bulk, ids, sizes, words = part + 1, 0, [], [], []
        if ids:
            yield from sent(part, ids, np.concatenate(sizes), np.concatenate(words))

    return rows.mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


def _count(dealt: DataFrame, deal: Deal, min_count: int) -> DataFrame:
    """The counts of a block's bigrams and words, sent to the parts that asked; bigrams that the table doesn't hold aren't answered."""

    def block(kind: int, src: int, e: Packed) -> Iterator[Row]:
        h, n, at = e.cols
        order = np.argsort(h)
        begin = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), begin), np.diff(np.r_[begin, len(h)]))
        if kind == _PAIRS:
            seen = np.flatnonzero(count >= min_count)
            e, at, count = e.take(seen), at[seen], count[seen]
        out = Packed(e.who, e.of, [at, count])
        yield from deal.rows(_PAIR_COUNTS if kind == _PAIRS else _WORD_COUNTS, src, deal.homes(e.who)[e.of], out)

    def made(batches: Batches) -> Iterator[Row]:
        by = grouped(batches)
        while by:
            task, kinds = by.popitem()
            asked = {k: kinds.pop(k) for k in (_PAIRS, _WORDS) if k in kinds}
            yield from ((task, kind, src, data) for kind, rows in kinds.items() for src, data in rows)
            for kind, own in asked.items():
                yield from block(kind, task, united([d for _, d in own]))

    return dealt.mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


def _score(dealt: DataFrame, alpha: float) -> DataFrame:
    """Documents' sums, but for log N."""

    def answers(rows: list[tuple[int, bytes]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        by: dict[int, list] = {}
        for _, data in rows:
            e = Packed.read(data)
            part = (e.who >> LOCAL).tolist()
            for i, p in enumerate(part):
                own = e.of == i if len(part) > 1 else slice(None)
                by.setdefault(p, []).append((e.cols[0][own].astype(np.int64), e.cols[1][own].astype(np.int64)))
        return by

    def counts(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for at, count in found:
            out[at] = count
        return out

    def part_scores(home: Packed, pairs: list, words: list) -> pa.RecordBatch:
        w, of, m = home.cols[0], home.of, len(home.who)
        real = w != _BEGIN
        value, seen = np.zeros(len(w)), np.zeros(len(w), bool)
        if real.any():
            vocabulary, which = np.unique(w[real], return_inverse=True)
            log_count = np.zeros(len(w))
            log_count[real] = np.log(counts(len(vocabulary), words))[which]
            value[real] = log_count[real]
            at, h = _bigrams(w)
            h, which = np.unique(h, return_inverse=True)
            c = counts(len(h), pairs)[which]
            seen[at] = c > 0
            value[at] = np.where(c > 0, np.log(np.maximum(c, 1)) - log_count[at - 1], np.log(alpha) + log_count[at])
        sums = [np.bincount(of, x, m) for x in (real, seen, value)]
        return pa.RecordBatch.from_arrays([pa.array(home.names, pa.string()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["id", "n_tokens", "n_seen", "logs"])

    def run(batches: Batches) -> Batches:
        by = grouped(batches)
        while by:
            _, kinds = by.popitem()
            pairs, words = (answers(kinds.pop(k, [])) for k in (_PAIR_COUNTS, _WORD_COUNTS))
            for _, data in kinds[_HOME]:
                home = Packed.read(data)
                part = home.who >> LOCAL
                for p in np.unique(part).tolist():
                    own = home if part[0] == part[-1] else home.take(np.flatnonzero((part == p)[home.of]))
                    yield part_scores(own, pairs.pop(p, []), words.pop(p, []))

    return dealt.mapInArrow(tidy(run), "id string, n_tokens long, n_seen long, logs double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """Per row of docs: id, n_tokens, n_seen (words scored by a bigram of the table), score.

    score is the sum of the natural logarithms of S over the words (A-Z lower-cased,
    split at ASCII white space); a first word is scored alpha-free by c(w) / N. A null,
    empty or blank text has 0 words and score 0. Repeated rows count, and are scored, each. Ids
    must cast to a string and back (null ids stay null); other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    deal = Deal.of(docs.sparkSession, max(12, -(-text_bytes(docs, text_col) // BLOCK_BYTES)))
    place = _place(deal)
    counted = _count(deal.dealt(_explode(rows, deal), place), deal, min_count)
    out = cut(_score(deal.dealt(counted, place), alpha))
    n = out.agg(F.sum("n_tokens")).first()[0] or 1
    score = F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.col("logs") - (F.col("n_tokens") - F.col("n_seen")) * F.log(F.lit(float(max(n, 1)))))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", "n_seen", score.alias("score"))
