"""Periodic runs of words: maximal repetitions by Kolpakov and Kucherov's method.

A run is a stretch of words that repeats with a smallest period q, as long as it can be,
of at least ``least`` words and ``fold`` periods. A text's words are first sieved: of a run
every window of a few words comes again one period away, so what lies between is cut off,
by sorting the windows of many texts at once. What is left of most texts is nothing. Each
stretch that is left, which holds its runs whole, goes through the method proper:

1. its LZ factors, by the first occurrences that a suffix automaton keeps;
2. for each border of factors the runs that cross or touch it, by Main's extensions left
   and right of the border for each period (Z functions of a window that the factors bound);
3. the runs strictly inside a factor, copied from the factor's earlier occurrence.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marque.llm.arrow import map_slices

#: A run has so many words and periods at least.
LEAST, FOLD = 6, 4
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd multiplier of the windows' hash; windows that collide are only kept needlessly.
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, end, period


def _z(a: list[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole."""
    n = len(a)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def lz_factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the first occurrence, or -1 for a new letter) of each LZ factor; occurrences may overlap.

    The suffix automaton takes some 700 bytes a letter.
    """
    moves: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        own = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = own
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] != size[p] + 1:
                twin = len(moves)
                moves.append(moves[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                q = twin
            link[own] = q
        last = own
    out = []
    i, n = 0, len(x)
    while i < n:
        state, length, source = 0, 0, -1
        while i + length < n:
            state = moves[state][x[i + length]]
            if (begin := first[state] - length) >= i:
                break
            length, source = length + 1, begin
        out.append((i, max(length, 1), source))
        i += max(length, 1)
    return out


def _touching(x: list[int], cuts: list[int], least: int, fold: int) -> dict[tuple[int, int], int]:
    """The runs that cross or touch a border of factors: (start, end) -> smallest period.

    A run counts for the last border up to its end. It begins less than a period before the factor that
    it runs over last, as that factor would else have been longer; this bounds the periods and the window.
    """
    found: dict[tuple[int, int], int] = {}
    for j in range(1, len(cuts)):
        b, final = cuts[j], j + 1 == len(cuts)
        hi = b if final else cuts[j + 1]
        back = cuts[max(j - 2, 0)]
        most = (hi - back - 1) // (fold - 1)
        lo = max(0, back - most)
        if most < 1 or hi - lo < least:
            continue
        right, left = min(most, hi - b), min(most, b - lo)
        ahead = _z([*x[b:hi], -1, *x[b - left : hi]])
        behind = _z([*x[lo:b][::-1], -1, *x[lo : b + right][::-1]])
        f0, g0 = hi - b + 1 + left, b - lo + 1 + right
        spans = [(b - behind[g0 - p], b + p + (ahead[p] if p < hi - b else 0), p) for p in range(1, right + 1)]
        spans += [(b - p - (behind[p] if p < b - lo else 0), b + ahead[f0 - p], p) for p in range(1, left + 1)]
        for s, e, p in spans:
            if e - s >= fold * p and e - s >= least and (e < hi or final) and (s > lo or lo == 0) and found.get((s, e), p) >= p:
                found[s, e] = p
    return found


def runs_of(x: list[int], least: int = LEAST, fold: int = FOLD) -> list[Run]:
    """All runs of a sequence: (start, end, period) by start and period."""
    if len(x) < least:
        return []
    factors = lz_factors(x)
    found = _touching(x, [*(f[0] for f in factors), len(x)], least, fold)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in found.items():
        by_start.setdefault(s, []).append((e, p))
    for b, n, source in factors:
        if source < 0:
            continue
        shift = b - source
        for s in range(b + 1, b + n - least):
            for e, p in by_start.get(s - shift, ()):
                if e + shift < b + n:
                    by_start.setdefault(s, []).append((e + shift, p))
    return sorted((s, e, p) for s, own in by_start.items() for e, p in own) if by_start else []


def window_words(least: int = LEAST, fold: int = FOLD) -> int:
    """How many words a window may have so that each window of a run comes again one period away."""
    return max(1, min(max(least, fold * q) - 2 * q + 1 for q in range(1, least + 1)))


def sieve(words: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, fold: int = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (begin, end) of the given stretches of words that may hold runs; every run lies within one.

    words: a 64-bit number for each, equal for equal words.
    """
    g = window_words(least, fold)
    n = len(words) - g + 1
    if n <= 0:
        return begin[:0], end[:0]
    key = np.zeros(n, np.uint64)
    for t in range(g):
        key = key * _MIX + words[t : t + n]
    key ^= key >> np.uint64(29)
    while True:
        whole = end - begin >= least
        begin, end = begin[whole], end[whole]
        count = end - begin - g + 1  # windows of each stretch
        total = int(count.sum())
        if not total:
            return begin, end
        which = np.repeat(np.arange(len(begin)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + begin[which]
        own = key[at] * _MIX + which.astype(np.uint64)
        order = np.argsort(own, kind="stable")
        place = at[order]
        near = np.full(total, len(words) + 1)
        same = own[order][1:] == own[order][:-1]
        gap = np.where(same, place[1:] - place[:-1], len(words) + 1)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        stay = near * fold <= (end - begin)[which]
        where = at[stay]
        if where.size == total or not where.size:
            return (begin, end) if where.size else (begin[:0], end[:0])
        new = np.flatnonzero(np.r_[True, (np.diff(where) != 1) | (np.diff(which[stay]) != 0)])
        begin, end = where[new], where[np.r_[new[1:] - 1, where.size - 1]] + g


def text_runs(texts: list[str | None], least: int = LEAST, fold: int = FOLD) -> tuple[list[list[str]], list[list[Run]]]:
    """The words and the runs of each text."""
    words = [_WORDS.findall(t) if t else [] for t in texts]
    stop = np.cumsum([len(w) for w in words], dtype=np.int64)
    start = np.r_[np.int64(0), stop[:-1]] if len(stop) else stop
    flat = [x for w in words for x in w]
    numbers = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    runs: list[list[Run]] = [[] for _ in texts]
    for a, b in zip(*(c.tolist() for c in sieve(numbers, start, stop, least, fold)), strict=True):
        doc = int(np.searchsorted(stop, a, side="right"))
        letters: dict[str, int] = {}
        shift = a - int(start[doc])
        runs[doc] += [(s + shift, e + shift, p) for s, e, p in runs_of([letters.setdefault(w, len(letters)) for w in flat[a:b]], least, fold)]
    return words, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run repeats: all of a run but its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, e, p in runs:
        keep[s + p : e] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """docs with an array of (start, length, period) of a text's runs of words, in place of a column of that name.

    Words are runs of characters other than ASCII white space, numbered from 0. Null, empty and blank texts have no
    runs. least: words of a run (1 or more); fold: periods (2 or more). No shuffle; any number of rows may be equal.
    """
    if least < 1 or fold < 2:
        raise ValueError("least must be 1 or more, fold 2 or more")
    docs = docs.drop(runs_col)
    names = docs.columns
    kind = T._parse_datatype_string("array<struct<start:bigint,length:bigint,period:bigint>>")
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_col, kind)])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, runs = text_runs(batch.column(at).to_pylist(), least, fold)
        own = [[{"start": s, "length": e - s, "period": p} for s, e, p in r] for r in runs]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))], [*names, runs_col])

    return map_slices(docs, run, schema, by=at)


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """docs with each text's runs cut to their first period; texts without runs stay as they are, others are joined by one space."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        out = [" ".join(collapsed(w, r)) if r else t for t, w, r in zip(texts, *text_runs(texts, least, fold), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)

    return map_slices(docs, run, docs.schema, by=at)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """id, n_runs, the longest run (start, length, period, exponent_milli) and SHA-256 of all runs and of the collapsed words.

    Of runs of one length the first, then that of the smallest period; without runs the four are null. A null text
    counts as empty. Repeated rows give repeated results; other columns are not read. No shuffle.
    """
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    texts = ("runs_sha256", "collapsed_sha256")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in (*longs, *texts)]
        for words, runs in zip(*text_runs(batch.column(1).to_pylist(), least, fold), strict=True):
            s, e, p = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
            row = [len(runs), s, None, p, None] if s is None else [len(runs), s, e - s, p, 1000 * (e - s) // p]
            row.append(hashlib.sha256("".join(f"{s},{e - s},{p}\n" for s, e, p in runs).encode()).hexdigest())
            row.append(hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        arrays = [pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip((*longs, *texts), out, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *longs, *texts])

    t = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {t}, " + ", ".join([*(f"{n} long" for n in longs), *(f"{n} string" for n in texts)])
    return map_slices(rows, run, schema, by=1).withColumnRenamed("id", id_col)
