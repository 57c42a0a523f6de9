"""Byte-pair encoding with numpy: batched, rank-synchronous merge rounds over ragged arrays.

``WordBpe`` reads a ``tokenizers`` JSON file of the "BPE with word ends" kind (NFC,
white space collapsed, lower case, split into pre-tokens, bytes as symbols, the last
symbol of a pre-token marked) and reproduces that library's ids without it.

A merge round holds the symbols of many pre-tokens in one flat array. The ranks of all
adjacent pairs come from one binary search over the sorted pair keys; each pre-token then
applies its own lowest-ranked pair, everywhere in it at once, and pre-tokens without a
mergeable pair leave the array. A pair made of a merged symbol always has a later rank than
the pair that made that symbol, so merging every occurrence at once equals the usual
one-at-a-time order.

The pre-tokens of a run of non-space characters don't depend on what is around it (no rule
matches white space), so encoded runs are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import numpy as np

#: Runs of non-space characters kept encoded in a worker unless told otherwise; beyond it the cache starts anew.
CACHE_RUNS = 300_000
#: Runs longer than this (bytes are bounded by the text itself) aren't kept.
CACHE_RUN_CHARS = 200
#: str.split() also splits at these four, which aren't white space to Unicode.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# White space; letters and numbers of Unicode 16 that Unicode 15.1 lacks; capitals with a later lower case: (first, last, lower case of the first).
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS_16 = "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
_NUMBERS_16 = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
#: A pair that Unicode composes and the library doesn't.
_APART = "\U00011935\U00011930"
_LOWER = {a + i: low + i for a, b, low in _CAPITALS for i in range(b - a + 1)}
_SPACE = re.compile(f"[{_SPACES}]+")
_LATER = re.compile(f"[{''.join(map(chr, _LOWER))}]")


@cache
def _classes() -> tuple[str, str]:
    """Letters and numbers as the insides of character classes, by Unicode 16 whatever Python's own version (15.1 or 16)."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        own = ranges.get(unicodedata.category(chr(c))[0])
        if own is None:
            continue
        if own and own[-1][1] == c - 1:
            own[-1][1] = c
        else:
            own.append([c, c])
    letters, numbers = ("".join(f"{chr(a)}-{chr(b)}" for a, b in ranges[k]) for k in "LN")
    return letters + _LETTERS_16, numbers + _NUMBERS_16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def merge_rounds(flat: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge ragged sequences until none has a known pair.

    flat: symbols of all sequences, one after the other; lengths: symbols of each.
    keys: sorted ``left * base + right`` of the known pairs, with their ranks and products.
    Returns the merged symbols and the lengths, in the order of the input.
    """
    none = np.iinfo(np.int64).max
    n = len(lengths)
    out_len = lengths.astype(np.int64).copy()
    parts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    owner = np.repeat(np.arange(n), lengths)
    flat = flat.astype(np.int64)
    while flat.size:
        key = flat[:-1] * base + flat[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.full(flat.size, none)
        rank[:-1] = np.where((keys[at] == key) & (owner[:-1] == owner[1:]), ranks[at], none)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, flat.size])
        best = np.repeat(np.minimum.reduceat(rank, first), size)
        live = best < none
        if not live.all():  # those without a pair are done
            parts.append(flat[~live])
            owners.append(owner[~live])
            flat, owner, rank, best, at = flat[live], owner[live], rank[live], best[live], np.r_[at, 0][live]
            if not flat.size:
                break
        hit = rank == best
        where = np.flatnonzero(hit)
        if where.size > 1:  # of overlapping pairs of one symbol ("aaa") every other one counts, from the left
            run = np.cumsum(np.r_[True, np.diff(where) != 1])
            start = np.flatnonzero(np.r_[True, np.diff(run) != 0])
            where = where[(np.arange(where.size) - start[run - 1]) % 2 == 0]
        flat[where] = made[at[where]]
        keep = np.ones(flat.size, bool)
        keep[where + 1] = False
        np.subtract.at(out_len, owner[where], 1)
        flat, owner = flat[keep], owner[keep]
    if not parts:
        return np.zeros(0, np.int64), out_len
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    return flat[np.argsort(owner, kind="stable")], out_len


class WordBpe:
    """The vocabulary, and the encoding of runs, texts and ids by it."""

    def __init__(self, path: str):
        self.limit = CACHE_RUNS
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab |= self.specials
        self.tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = len(self.tokens)
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, numbers = _classes()
        self.split = re.compile(split.replace(r"\s", _SPACES).replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.marks = sorted({s[0] + s[1:2] for s in self.specials})
        self.known: dict[str, tuple[int, ...]] = {}
        self.text_ids = [str(i) for i in range(len(self.tokens))]

    def runs(self, text: str) -> list[str]:
        """Runs of non-space characters in order, normalised unless a special token may be in the run."""
        if any(m in text for m in self.marks):
            return [r if any(m in r for m in self.marks) else self._normal(r) for r in self._cut(text)]
        return self._cut(self._normal(text))

    @staticmethod
    def _cut(text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            # The library lowers each character by itself: no final sigma.
            text = _APART.join(unicodedata.normalize("NFC", t) for t in text.split(_APART)).replace("Σ", "σ")
            if _LATER.search(text):
                return text.lower().translate(_LOWER)
        return text.lower()

    def _pretokens(self, run: str) -> list[str | int]:
        """Pre-tokens of a run; an int stands for a special token."""
        if run.isalpha():
            return [run]
        if self.special is None or not any(m in run for m in self.marks):
            return self.split.findall(run)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(run):
            out += self.split.findall(self._normal(run[at : m.start()]))
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self.split.findall(self._normal(run[at:]))

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens, by one set of merge rounds over all of them."""
        coded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        flat[ends] = self.last[raw[ends]]
        flat, sizes = merge_rounds(flat, sizes, self.keys, self.ranks, self.made, self.base)
        ids, stop = flat.tolist(), np.cumsum(sizes).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stop], stop, strict=False)]

    def encode_runs(self, runs: list[str]) -> list[tuple[int, ...]]:
        """Ids of each run; pre-tokens met before come from a bounded cache."""
        pre = list(map(self._pretokens, runs))
        new = [p for p in {p for ps in pre for p in ps if p not in self.known} if type(p) is str]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = [p for p in {p for ps in pre for p in ps} if type(p) is str]
        if new:
            self.known.update(zip(new, self.merge(new), strict=True))
        known = self.known
        return [known[ps[0]] if len(ps) == 1 and type(ps[0]) is str else tuple([i for p in ps for i in (known[p] if type(p) is str else (p,))]) for ps in pre]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode without a decoder: the tokens, joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class RunCache(dict):
    """Bounded: run -> what ``make`` gives for its ids."""

    def __init__(self, bpe: WordBpe, make):
        super().__init__()
        self.bpe, self.make = bpe, make

    def of(self, runs: list[list[str]]) -> list[list]:
        """For each list of runs, what its runs stand for."""
        new = list(set().union(*runs).difference(self.keys()))
        if len(self) + len(new) > self.bpe.limit:
            self.clear()
            new = list(set().union(*runs))
        made = {}
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            made |= zip(some, map(self.make, self.bpe.encode_runs(some)), strict=True)
        self.update(made)
        got = [list(map(self.__getitem__, r)) for r in runs]
        for r in new:
            if len(r) > CACHE_RUN_CHARS:
                del self[r]
        if len(self) > self.bpe.limit:
            self.clear()
        return got


_LOADED: dict[tuple, RunCache] = {}


def loaded(path: str, kind: str, make, limit: int = CACHE_RUNS) -> RunCache:
    """One vocabulary and cache for a worker, file and use."""
    if (path, kind) not in _LOADED:
        bpe = next((c.bpe for (p, _), c in _LOADED.items() if p == path), None) or WordBpe(path)
        _LOADED[path, kind] = RunCache(bpe, make(bpe))
    _LOADED[path, kind].bpe.limit = limit
    return _LOADED[path, kind]


def unload() -> None:
    """Empty the caches and drop the vocabularies too, some 17 MB each; the next task loads its own again."""
    forget()
    _LOADED.clear()


def forget() -> None:
    """Empty the caches, as workers outlive their tasks; the vocabularies stay."""
    for cache in _LOADED.values():
        cache.clear()
        cache.bpe.known.clear()
