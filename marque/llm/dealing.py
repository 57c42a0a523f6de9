"""Packed entries dealt to hash blocks, in levels of bounded fan-out.

An entry says something of one text: numbers in columns, and the text by its place ``who``.
Entries travel packed: a row holds many, with the texts that they are of listed once. A task
that sent a row to every block would make rows with the square of the input, so above FAN
blocks they travel in levels, like a radix sort: first to as many groups of blocks as the
base, then within the group to a smaller one, until it's a single block. Every row made is
one of at most FAN of a bounded piece of work, so rows grow with the input and no faster.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marque.llm.arrow import tidy
from marque.llm.hashing import mix
from marque.llm.shared import even_keys

#: Most rows that a piece of work makes for one kind of entries.
FAN = 256
#: Blocks up to which tasks get one each; more are dealt to tasks by their number's hash.
EVEN = 65_536
#: Bits of a text's place within its part.
LOCAL = np.uint64(16)
#: Rows and bytes of an Arrow batch sent on.
BATCH_ROWS, BATCH_BYTES = 500, 4_000_000

SCHEMA = "task int, kind int, src long, data binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
Row = tuple[int, int, int, bytes]


def _planes(x: np.ndarray) -> bytes:
    """Non-negative integers as their lower bytes, plane by plane: as many as the largest needs. (Planes of one value take no room.)"""
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([w]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes()


def _from_planes(raw: bytes, at: int, m: int) -> tuple[np.ndarray, int]:
    w = raw[at]
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :w] = np.frombuffer(raw, np.uint8, w * m, at + 1).reshape(w, m).T
    return wide.view("<u8").ravel(), at + 1 + w * m


_PLAIN, _FLOATS, _RUNS, _WORDS = range(4)


def _column(x: np.ndarray) -> bytes:
    """A column as it's shortest: floats; runs of equal numbers; numbers of a list of the different ones; or the numbers."""
    if x.dtype.kind == "f":
        return bytes([_FLOATS]) + x.astype("<f8").tobytes()
    m = len(x)
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if m else np.zeros(0, np.int64)
    if 2 * len(begin) < m:
        return bytes([_RUNS]) + len(begin).to_bytes(4, "little") + _planes(x[begin]) + _planes(np.diff(np.r_[begin, m]))
    some = np.sort(x[:: m // 1000 + 1])
    if m > 100 and int(some[-1]) >> 32 and np.count_nonzero(some[1:] != some[:-1]) + 1 < 0.9 * len(some):
        values, at = np.unique(x, return_inverse=True)
        if 2 * len(values) < m:
            return bytes([_WORDS]) + len(values).to_bytes(4, "little") + _planes(values) + _planes(at)
    return bytes([_PLAIN]) + _planes(x)


def _from_column(raw: bytes, at: int, m: int) -> tuple[np.ndarray, int]:
    kind, at = raw[at], at + 1
    if kind == _FLOATS:
        return np.frombuffer(raw, "<f8", m, at), at + 8 * m
    if kind == _PLAIN:
        return _from_planes(raw, at, m)
    k = int.from_bytes(raw[at : at + 4], "little")
    values, at = _from_planes(raw, at + 4, k)
    if kind == _RUNS:
        n, at = _from_planes(raw, at, k)
        return np.repeat(values, n.astype(np.int64)), at
    which, at = _from_planes(raw, at, m)
    return values[which.astype(np.int64)], at


class Packed:
    """Entries of texts: who (places of texts), about and names (columns of these), of (which text an entry is of), cols (columns of entries)."""

    def __init__(self, who: np.ndarray, of: np.ndarray, cols: list[np.ndarray], about: tuple[np.ndarray, ...] = (), names: np.ndarray | None = None) -> None:
        self.who, self.of, self.cols, self.about, self.names = who, of, cols, about, names

    def __len__(self) -> int:
        return len(self.of)

    def take(self, at: np.ndarray | slice) -> Packed:
        """Some entries, with only the texts that they are of."""
        of = self.of[at]
        held = np.zeros(len(self.who), bool)
        held[of] = True
        return Packed(self.who[held], (np.cumsum(held) - 1)[of], [c[at] for c in self.cols], tuple(a[held] for a in self.about), None if self.names is None else self.names[held])

    def data(self) -> bytes:
        out = [np.array([len(self.who), len(self.of), len(self.about), len(self.cols), self.names is not None], "<u4").tobytes()]
        for x in (self.who, *self.about, self.of, *self.cols):
            out.append(_column(x))
        if self.names is not None:
            spelled = [b"" if x is None else b"\x01" + x.encode("utf-8", "surrogatepass") for x in self.names]
            out += [_column(np.array([len(x) for x in spelled], np.int64)), *spelled]
        raw = b"".join(out)
        return len(raw).to_bytes(5, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def read(cls, data: bytes) -> Packed:
        raw = pa.decompress(memoryview(data)[5:], decompressed_size=int.from_bytes(data[:5], "little"), codec="zstd", asbytes=True)
        texts, entries, n_about, n_cols, named = np.frombuffer(raw, "<u4", 5).tolist()
        at, got = 20, []
        for m in [texts] * (1 + n_about) + [entries] * (1 + n_cols) + [texts] * named:
            x, at = _from_column(raw, at, m)
            got.append(x)
        names = None
        if named:
            end = at + np.cumsum(got.pop())
            names = np.array([raw[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else None for a, b in zip([at, *end.tolist()], end.tolist(), strict=False)], object)
        return cls(got[0], got[1 + n_about].astype(np.int64), got[2 + n_about :], tuple(got[1 : 1 + n_about]), names)


def united(rows: list[bytes]) -> Packed:
    """The entries of several rows, in their order; each text once, by place."""
    read = [Packed.read(d) for d in rows]
    if len(read) == 1:
        return read[0]
    first = np.cumsum([0, *[len(p.who) for p in read]])
    who, at, where = np.unique(np.concatenate([p.who for p in read]), return_index=True, return_inverse=True)
    of = where[np.concatenate([p.of + a for p, a in zip(read, first, strict=False)])]
    cols = [np.concatenate(c) for c in zip(*[p.cols for p in read], strict=True)]
    about = tuple(np.concatenate(a)[at] for a in zip(*[p.about for p in read], strict=True))
    return Packed(who, of, cols, about, None if read[0].names is None else np.concatenate([p.names for p in read])[at])


@dataclass(frozen=True)
class Deal:
    """How entries come to their blocks: base ** levels of them."""

    base: int
    levels: int
    keys: tuple[int, ...]

    @classmethod
    def of(cls, spark: SparkSession, blocks: int) -> Deal:
        levels = 1
        while FAN**levels < blocks:
            levels += 1
        base = 1
        while base**levels < blocks:
            base += 1
        return cls(base, levels, tuple(even_keys(spark, base**levels)) if base**levels <= EVEN else ())

    @property
    def blocks(self) -> int:
        return self.base**self.levels

    def key(self, i: int) -> int:
        return self.keys[i] if self.keys else i

    def place(self, h: np.ndarray) -> np.ndarray:
        """Blocks of 64-bit hashes, each a range of them: what those of a row share takes no room."""
        return ((h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)

    def homes(self, who: np.ndarray) -> np.ndarray:
        """Blocks of texts, which those of a part share."""
        return self.place(mix(who >> LOCAL))

    def rows(self, kind: int, src: int, block: np.ndarray, entries: Packed, level: int = 0) -> Iterator[Row]:
        """One row for each group of blocks of a level."""
        if not len(block):
            return
        spread = self.base ** (self.levels - 1 - level)
        group, slot = block // spread, int(mix(np.array([src], np.int64).view(np.uint64))[0]) % spread
        if (group[1:] < group[:-1]).any():
            order = np.argsort(group.astype(np.uint16) if self.base <= 65_536 else group, kind="stable")  # so narrow, by radix
            group, entries = group[order], Packed(entries.who, entries.of[order], [c[order] for c in entries.cols], entries.about, entries.names)
            del order, block
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(group)], strict=True):
            yield self.key(int(group[a]) * spread + slot), kind, src, entries.take(slice(a, b)).data()

    def dealt(self, rows: DataFrame, place: Callable[[int, Packed], np.ndarray]) -> DataFrame:
        """Rows of level 0 come to their blocks; place: the blocks of entries of a kind."""
        for level in range(1, self.levels):
            rows = rows.repartition(self.blocks, "task").mapInArrow(tidy(self._on(place, level)), SCHEMA)
        return rows.repartition(self.blocks, "task")

    def _on(self, place: Callable[[int, Packed], np.ndarray], level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = grouped(batches)

            def on() -> Iterator[Row]:
                while by:
                    task, kinds = by.popitem()
                    for kind, own in kinds.items():
                        own.sort()
                        entries = united([d for _, d in own])
                        yield from self.rows(kind, task, place(kind, entries), entries, level)

            yield from batched(on())

        return run


def grouped(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[tuple[int, bytes]]]]:
    """task -> kind -> (src, data) of all rows of a partition."""
    by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for b in batches:
        for task, kind, src, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by[task][kind].append((src, data))
    return by


def batched(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held: list[Row] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["task", "kind", "src", "data"])
