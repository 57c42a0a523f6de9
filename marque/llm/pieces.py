"""SentencePiece byte-pair pieces: the model file, segmentation of distinct chunks, and decoding.

``PieceModel`` reads a ``sentencepiece`` model of the BPE kind with byte fallback and
reproduces that library's ids without it. Spaces become markers and one marker leads the
text. No piece holds a marker after another character, so a text falls into chunks - a run
of markers with the characters up to the next marker - whose pieces don't depend on their
neighbours: a distinct chunk is segmented once and its ids are joined back by position.

Segmentation merges, again and again, the neighbours whose joint text is the best-scored
piece, the leftmost of equals. A round does that for all chunks at once, one merge a chunk,
in flat arrays; long chunks go through a heap instead, as rounds would cost the square of
their length.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

# The marker, and the types of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Chunks of more symbols than this are segmented by a heap.
LONG = 48
#: Chunks kept segmented in a worker; beyond it the table starts anew.
TABLE_CHUNKS = 200_000
#: What decoding gives for the unknown piece, unless the model says otherwise.
UNKNOWN_TEXT = " ⁇ "


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = raw[i]
            out |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return out, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("marque-each-byte", _each_byte)


class PieceModel:
    """The pieces of a model file; segmentation of chunks and decoding of ids."""

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        self.limit = limit
        self.known: dict = {}
        pieces: list[tuple[str, float, int]] = []
        kind, fallback, prefix, strip, charsmap, escape, suffix, self.unknown_text = 1, 0, 1, 1, b"", 1, 0, UNKNOWN_TEXT
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                    pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
                elif number == 2:
                    trainer = dict(_fields(value))
                    kind, fallback, suffix = trainer.get(3, 1), trainer.get(35, 0), trainer.get(24, 0)
                    self.unknown_text = trainer[44].decode() if 44 in trainer else UNKNOWN_TEXT
                elif number == 3:
                    normal = dict(_fields(value))
                    charsmap, prefix, strip, escape = normal.get(2, b""), normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)
        plain = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        multi = [t for t in plain if len(t) > 1]
        if kind != 2 or not fallback or charsmap or not prefix or strip or not escape or suffix or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError(f"{path}: only BPE models with byte fallback, a leading marker and unchanged text are read")
        if any(MARK in t.lstrip(MARK) for t in multi):
            raise ValueError(f"{path}: pieces cross markers")
        self.kinds = [k for _, _, k in pieces]
        self.texts = [t.replace(MARK, " ") if k == NORMAL else "" for t, _, k in pieces]
        self.bytes = {i: int(t[3:5], 16) for i, (t, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_ids = [i for i, _ in sorted(self.bytes.items(), key=lambda x: x[1])]
        self.id_texts = [str(i) for i in range(len(pieces))]
        # Characters that are pieces, by code point; others get a number beyond the pieces and never merge.
        chars = sorted((ord(t), i) for t, i in plain.items() if len(t) == 1)
        self.points, self.point_ids = (np.array(c, np.int64) for c in zip(*chars, strict=True))
        # All pairs that make a piece: sorted keys with the product and its place by descending score.
        self.base = len(pieces) + 1
        order = {s: r for r, s in enumerate(sorted({pieces[plain[t]][1] for t in multi}, reverse=True))}
        pairs = sorted((plain[t[:k]] * self.base + plain[t[k:]], order[pieces[i][1]], i) for t, i in plain.items() for k in range(1, len(t)) if t[:k] in plain and t[k:] in plain)
        self.keys, self.ranks, self.made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self._pairs: dict[int, tuple[int, int]] | None = None
        # Line ends and tabs merge with nothing in most models, and are then chunks of their own.
        inside = {c for t in multi for c in t}
        alone = "".join(c for c in "\n\t" if c not in inside)
        self.chunk = re.compile(f"[ {MARK}]*[^ {MARK}{alone}]+|[ {MARK}]+" + (f"|[{alone}]" if alone else ""))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text in order, led by the marker; they join to the text with a space before it."""
        return self.chunk.findall(" " + text) if text else []

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all chunks and the number in each; a character that is no piece is -1 less its code point."""
        points = np.frombuffer("".join(texts).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.point_ids[at], -1 - points), np.fromiter(map(len, texts), np.int64, len(texts))

    def _rounds(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all sequences side by side, the best pair of each a round; (symbols, owners) in no order of owners."""
        none = np.iinfo(np.int64).max
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done, owners = [], []
        while flat.size:
            left, right = flat[:-1], flat[1:]
            key = left * self.base + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (owner[:-1] == owner[1:]) & (left >= 0) & (right >= 0)
            rank = np.append(np.where(ok, self.ranks[at], none), none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, flat.size]))
            over = best == none
            done.append(flat[over])
            owners.append(owner[over])
            hit = np.flatnonzero((rank == best) & ~over)
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]] if hit.size else hit  # the leftmost of each
            flat[hit] = self.made[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            flat, owner = flat[keep], owner[keep]
        return np.concatenate([*done, flat]), np.concatenate([*owners, owner])

    def _heaped(self, symbols: list[int]) -> list[int]:
        """The same for one long sequence, in n log n steps."""
        if self._pairs is None:
            self._pairs = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        n, base, pairs = len(symbols), self.base, self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if symbols[i] >= 0 and symbols[j] >= 0 and (got := pairs.get(key := symbols[i] * base + symbols[j])):
                heapq.heappush(heap, (got[0], i, key, got[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] < 0 or symbols[i] * base + symbols[j] != key:
                continue
            symbols[i], gone[j], after[i] = made, True, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def _fall_back(self, symbols: list[int]) -> tuple[int, ...]:
        if min(symbols) >= 0:
            return tuple(symbols)
        return tuple(i for s in symbols for i in ((s,) if s >= 0 else map(self.byte_ids.__getitem__, chr(-1 - s).encode())))

    def encode_runs(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk."""
        out: list[tuple[int, ...]] = [()] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            flat, owner = self._rounds(*self._symbols([texts[i] for i in short]))
            flat = flat[np.argsort(owner, kind="stable")].tolist()
            stop = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
            for i, a, b in zip(short, [0, *stop], stop, strict=False):
                out[i] = self._fall_back(flat[a:b])
        for i, t in enumerate(texts):
            if len(t) > LONG:
                out[i] = self._fall_back(self._heaped(self._symbols([t])[0].tolist()))
        return out

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids, with the space of every marker; bytes that are no UTF-8 become replacement characters."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode(errors="marque-each-byte"))
                held.clear()
            out.append(self.unknown_text if self.kinds[i] == UNKNOWN else self.texts[i])
        if held:
            out.append(held.decode(errors="marque-each-byte"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode: the surface without the marker that led the text."""
        ids = list(ids)
        lead = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self.surface(ids)
        return text[1:] if lead is not None and self.kinds[lead] == NORMAL and self.texts[lead].startswith(" ") else text
