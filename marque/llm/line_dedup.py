"""Near-duplicate lines by MinHash, kept once in the corpus.

Lines of at least ``min_chars`` characters are eligible; shorter ones are left alone or, with
``short_lines``, compared as one shingle each: by equality. The steps for long ones:
character-shingle MinHash signatures of different lines; banding, with band hashes packed
and dealt to blocks (``dealing``), where those of several lines come out; exact Jaccard of all pairs of a band that aren't linked yet; distributed union-find over the
links; and removal of every line of a component but the first (by id, then line number).

Byte-equal texts are one row until the end: of rows with one text, those with a larger id
than the first lose all eligible lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import slices, tidy
from marque.llm.components import connected_components
from marque.llm.dealing import SCHEMA, Deal, Packed, Row, batched, grouped, united
from marque.llm.hashing import mix
from marque.llm.ngram_join import SEEN, forest
from marque.llm.shared import cut, drop, text_bytes, text_key

#: Characters of a shingle where the caller names none (the queries and the pipeline use QUERY_SHINGLE), and the longest.
SHINGLE = 9
QUERY_SHINGLE = 6
#: A pair at exactly 0.8 misses every band once in 6,200 (16 bands of 4 rows: 4,600); unlike lines seldom meet.
BANDS, ROWS = 22, 5
#: Eligible lines packed together, text bytes for each hash block, different lines of a band compared in one block.
PART_LINES = 20_000
BLOCK_BYTES = 8_000_000
BAND_LINES = 512
#: Different lines from which a place is taken by itself, and pairs that may be alike, a line, from which overlaps come from a matrix product.
WIDE_LINES, NEAR_PAIRS = 48, 40
#: Cells of a line's presence bitmap (several times the shingles of most lines, so that few unlike pairs pass it), pairs whose
#: bitmaps are compared at once, and characters of lines whose bands are.
BITS = 4096
BIT_PAIRS = 4096
FOREST_CHARS = 2_000_000
#: Estimated bytes up to which a side is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32_000_000

#: Kinds of rows: lines; band hashes.
_LINE, _BAND = range(2)
#: Of a band's hash the upper 48 bits count: bands that meet by chance are compared, and found unlike.
_TOKEN = ~np.uint64(0xFFFF)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Batches = Iterator[pa.RecordBatch]
_SALT = np.random.default_rng(7).integers(1, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.random.default_rng(8).integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _fold(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")


def _shingles(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles (of ASCII-lower-cased lines), and where each line's begin."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    c = _fold("".join(lines)).astype(np.uint64)
    upper = (c >= 65) & (c <= 90)
    c[upper] += np.uint64(32)
    n = np.maximum(length - size + 1, 1)  # eligible lines are longer than a shingle
    h = np.zeros(max(0, len(c) - size + 1), np.uint64)
    for j in range(size):
        h += c[j : j + len(h)] * _STEP[j]
    start = np.cumsum(length) - length
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(start - first, n)
    return mix(h[at]), first


def _lines(text: str, least: int) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate(text.split("\n")) if len(x) >= least]


def _signed(texts: list[str], size: int, seen: set[int], bits: int, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lines, and second hashes; and the band hashes of those not seen before, with the line's hash. seen: hashes, added to.

    Of a hash in again the second one takes the place.
    """
    tokens, owners, whole, checks = [], [], [], []
    for i in range(0, len(texts), 1000):  # shingles of some lines at once: what stays in a processor's cache
        h, first = _shingles(texts[i : i + 1000], size)
        v = mix(h ^ np.uint64(0x5BD1E995))
        line = mix(np.add.reduceat(v, first)) >> np.uint64(64 - bits)  # of the set with repeats; equal lines agree
        check = mix(np.bitwise_xor.reduceat(v, first))
        if len(again):
            line = np.where(np.isin(line, again), mix(check ^ np.uint64(0xC2B2AE35)), line)
        whole.append(line)
        checks.append(check)
        _, at = np.unique(line, return_index=True)
        new = np.array([j for j in np.sort(at).tolist() if int(line[j]) not in seen], np.int64)
        if not len(new):
            continue
        seen.update(line[new].tolist())
        count = np.diff(np.r_[first, len(h)])[new]
        first, low = np.cumsum(count) - count, (h >> np.uint64(32)).astype(np.uint32)[np.repeat(first[new] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        sig = np.empty((len(first), BANDS * ROWS), np.uint64)
        v = np.empty_like(low)
        for k, salt in enumerate(_SALT):  # an odd factor permutes the 32-bit hashes
            np.multiply(low, salt, out=v)
            sig[:, k] = np.minimum.reduceat(v, first)
        band = np.zeros((len(first), BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band + sig[:, r::ROWS] + np.uint64(r))
        tokens.append(mix(band + np.arange(BANDS, dtype=np.uint64)).ravel() & _TOKEN)
        owners.append(np.repeat(line[new], BANDS))
    none = np.zeros(0, np.uint64)
    return np.concatenate(whole), np.concatenate(checks), np.concatenate([none, *tokens]), np.concatenate([none, *owners])


def _place(deal: Deal):
    return lambda kind, e: deal.place(e.cols[0]) if kind == _BAND else deal.place(mix(e.who[e.of]))


def _pack(rows: DataFrame, deal: Deal, least: int, size: int, bits: int, met: list[int]) -> DataFrame:
    """(key, text) -> lines (of a text: hash, line number, second hash) and the band hashes of different lines."""
    again = np.array(met, np.int64).view(np.uint64)

    def sent(part: int, own: list[tuple[int, int, str]], seen: set[int]) -> Iterator[Row]:
        whole, check, token, owner = _signed([x for _, _, x in own], size, seen, bits, again)
        key, of = np.unique(np.array([k for k, _, _ in own], np.int64).view(np.uint64), return_inverse=True)
        lines = Packed(key, of, [whole, np.array([i for _, i, _ in own], np.int64), check])
        yield from deal.rows(_LINE, part, deal.place(mix(key))[of], lines)
        hashes, of = np.unique(owner[::BANDS], return_inverse=True)
        yield from deal.rows(_BAND, part, deal.place(token), Packed(hashes, np.repeat(of, BANDS), [token]))

    def made(batches: Batches) -> Iterator[Row]:
        part, own = TaskContext.get().partitionId() << 24, []
        texts: set[int] = set()
        seen: set[int] = set()
        for batch in batches:
            for some in slices(batch, pc.binary_length(batch.column(1)).to_pylist()):
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if t and k not in texts:
                        texts.add(k)
                        own += [(k, i, x) for i, x in _lines(t, least)]
                whole = len(own) - len(own) % PART_LINES
                for i in range(0, whole, PART_LINES):
                    yield from sent(part, own[i : i + PART_LINES], seen)
                    part += 1
                del own[:whole]
                for held in (texts, seen):
                    if len(held) > SEEN:
                        held.clear()
        if own:
            yield from sent(part, own, seen)

    return rows.mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


_FOUND = "kind int, hash long, key long, line int, s1 long, s2 long, i int, blocks int, members array<long>"


def _gather(dealt: DataFrame) -> DataFrame:
    """Rows of kind _LINE: hash, key, line, and in s1 the second hash; and of kind _BAND: the different lines of a band of several.

    Of a band s1 and s2 tell sets of lines apart, hash is the least line; members are cut into blocks of BAND_LINES at most.
    """
    empty = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int64()))

    def row(kind: int, m: int, **cols: pa.Array) -> pa.RecordBatch:
        given = {"kind": pa.array(np.full(m, kind, np.int32)), **cols}
        schema = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("i", pa.int32()), ("blocks", pa.int32()), ("members", empty.type)])
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)

    def bands(rows: list[bytes]) -> pa.RecordBatch | None:
        read = [Packed.read(d) for d in rows]
        t, member = np.concatenate([p.cols[0] for p in read]), np.concatenate([p.who[p.of] for p in read])
        del read
        order = np.argsort(t)
        t = t[order]
        same = t[1:] == t[:-1]
        again = np.r_[same, False] | np.r_[False, same]  # most band hashes occur once
        t, member = t[again], member[order[again]]
        if not len(t):
            return None
        order = np.lexsort((member, t))
        t, member = t[order], member[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (member[1:] != member[:-1])]
        t, member = t[new], member[new]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n = np.diff(np.r_[first, len(t)])
        member, n = member[np.repeat(n > 1, n)], n[n > 1]  # sorted within a band
        if not len(n):
            return None
        first = np.cumsum(n) - n
        s1, s2 = np.add.reduceat(mix(member), first), np.bitwise_xor.reduceat(mix(member ^ np.uint64(0x5BD1E995)), first)
        blocks = -(-n // BAND_LINES)
        band = np.repeat(np.arange(len(n)), blocks)
        i = np.arange(len(band)) - (np.cumsum(blocks) - blocks)[band]
        begin = first[band] + i * BAND_LINES
        lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(member)].astype(np.int32)), pa.array(member.view(np.int64)))
        long = lambda x: pa.array(x[band].view(np.int64))
        return row(_BAND, len(band), hash=long(member[first]), s1=long(s1), s2=long(s2), i=pa.array(i.astype(np.int32)), blocks=pa.array(blocks[band].astype(np.int32)), members=lists)

    def run(batches: Batches) -> Batches:
        by = grouped(batches)
        while by:
            _, kinds = by.popitem()
            if _LINE in kinds:
                e = united([d for _, d in kinds.pop(_LINE)])
                whole, line, check = e.cols
                yield row(_LINE, len(e), s1=pa.array(check.view(np.int64)), hash=pa.array(whole.view(np.int64)), key=pa.array(e.who[e.of].view(np.int64)), line=pa.array(line.astype(np.int32)))
            if _BAND in kinds and (out := bands([d for _, d in kinds.pop(_BAND)])) is not None:
                yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

    return dealt.mapInArrow(tidy(run), _FOUND)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _set(h: np.ndarray) -> np.ndarray:
    """Without repeats, sorted."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]]


def _like(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets of shingles, each without repeats, are alike."""
    both = np.concatenate([p, q])
    both.sort()
    o = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * o >= percent * (len(p) + len(q) - o)


def _forest(place: np.ndarray, hashes: np.ndarray, comps: np.ndarray, texts: list[str], percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (component, component), a spanning forest of all pairs of like lines of different components in one place; place is sorted.

    For places of few lines. A pair whose presence bitmaps differ in more cells than two like sets can is passed over; all others are compared as sets.
    """
    _, at, line = np.unique(hashes, return_index=True, return_inverse=True)
    parts, n, bits = [], [], []
    for i in range(0, len(at), 500):
        h, first = _shingles([texts[j] for j in at[i : i + 500]], size)
        count = np.diff(np.r_[first, len(h)])
        cells = np.zeros((len(first), BITS), bool)
        cells[np.repeat(np.arange(len(first)), count), (h % np.uint64(BITS)).astype(np.int64)] = True
        parts += np.split(h, first[1:])
        n.append(count)
        bits.append(np.packbits(cells, axis=1).view("<u8"))
    n, bits = np.concatenate(n), np.concatenate(bits)
    label, group = np.unique(comps, return_inverse=True)
    parent = np.arange(len(label))
    sets: dict[int, np.ndarray] = {}
    a, b = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    def of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = _set(parts[x])
        return sets[x]

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        return (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])

    rows, d = np.arange(len(place)), 1
    while True:  # pairs d rows apart
        rows = rows[: np.searchsorted(rows, len(place) - d)]
        rows = rows[place[rows] == place[rows + d]]
        if not len(rows):
            break
        flat = parent
        while (flat != flat[flat]).any():
            flat = flat[flat]
        i = rows[flat[group[rows]] != flat[group[rows + d]]]
        x, y = line[i], line[i + d]
        near = np.concatenate([np.zeros(0, bool), *[close(x[j : j + BIT_PAIRS], y[j : j + BIT_PAIRS]) for j in range(0, len(x), BIT_PAIRS)]])
        for i, x, y in zip(i[near].tolist(), x[near].tolist(), y[near].tolist(), strict=True):
            r, s = root(group[i]), root(group[i + d])
            if r == s:
                continue
            if _like(of(x), of(y), percent):
                parent[max(r, s)] = min(r, s)
                a.append(r)
                b.append(s)
        d += 1
    return label[np.array(a, np.int64)], label[np.array(b, np.int64)]


def _wide(hashes: np.ndarray, comps: np.ndarray, texts: list[str], percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one place of many lines. Where many pairs may be alike, all overlaps come from one product."""
    _, at = np.unique(hashes, return_index=True)
    h, first = _shingles([texts[i] for i in at], size)
    sets, comps, m = [_set(x) for x in np.split(h, first[1:])], comps[at], len(at)
    count = np.array([len(x) for x in sets])
    line, h = np.repeat(np.arange(m), count), np.concatenate(sets)
    cells = np.zeros((m, BITS), bool)
    cells[line, (h % np.uint64(BITS)).astype(np.int64)] = True
    bits = np.packbits(cells, axis=1).view("<u8")
    near = []
    for i in range(0, m, 8):
        apart = np.bitwise_count(bits[i : i + 8, None] ^ bits[None, i:]).sum(2, dtype=np.int64)
        x, y = np.nonzero((100 + percent) * apart <= (100 - percent) * (count[i : i + 8, None] + count[None, i:]))
        y += i
        near.append(np.stack([x + i, y])[:, y > x + i])
    near = np.concatenate(near, axis=1)
    near = near[:, comps[near[0]] != comps[near[1]]]
    if near.shape[1] > NEAR_PAIRS * m:
        got = np.array(forest(comps, count, sets, percent), np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := top.get(c, c)) != c:
            c = up
        return c

    links = []
    for x, y in near.T.tolist():
        r, t = root(int(comps[x])), root(int(comps[y]))
        if r == t:
            continue
        if _like(sets[x], sets[y], percent):
            top[max(r, t)] = min(r, t)
            links.append((r, t))
    got = np.array(links, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _links(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between components of all like lines in one place; rows: place, hash, comp, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            place, hashes, comps = (np.array(x, np.int64) for x in zip(*[r[:3] for r in own], strict=True))
            texts = [r[3] for r in own]
            begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            n = np.diff(np.r_[begin, len(place)])
            some = np.flatnonzero(np.repeat(n < WIDE_LINES, n))
            got = [_forest(place[some], hashes[some], comps[some], [texts[i] for i in some], percent, size)] if len(some) else []
            got += [_wide(hashes[i : i + m], comps[i : i + m], texts[i : i + m], percent, size) for i, m in zip(begin.tolist(), n.tolist(), strict=True) if m >= WIDE_LINES]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in got])) for i in (0, 1)], ["a", "b"])

        own, chars = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chars >= FOREST_CHARS and own[-1][0] != r[0]:
                    yield out()
                    own, chars = [], 0
                own.append(r)
                chars += len(r[3])
        if own:
            yield out()

    return rows.select("place", "hash", "comp", "text").repartition("place").sortWithinPartitions("place").mapInArrow(tidy(run), "a long, b long")


def _short(line: Column, min_chars: int) -> Column:
    """Whether a line is short but not blank."""
    return (F.length(line) < min_chars) & line.rlike(r"(?U)\S")


def removed_lines(docs: DataFrame, key: Column, id_col: str, text_col: str, percent: int, min_chars: int, shingle: int, short_lines: bool, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with id, key, text; key -> removed line numbers; key -> first id, for texts of several ids)."""
    if not 1 <= shingle <= min(SHINGLE, min_chars):
        raise ValueError(f"shingle must be from 1 to {SHINGLE}, and min_chars at least that")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    total = text_bytes(docs, text_col)
    deal = Deal.of(spark, max(12, -(-total // BLOCK_BYTES)))
    met: list[int] = []
    while True:  # unlike lines whose hashes meet, seldom any, get their second hashes in another run
        found = cut(_gather(deal.dealt(_pack(rows.select("key", "text"), deal, min_chars, shingle, hash_bits, met), _place(deal))))
        every = found.where(F.col("kind") == _LINE).select("hash", "key", "line")
        reps = cut(found.where(F.col("kind") == _LINE).groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min_by("line", "key").alias("line"), F.min("s1").alias("lo"), F.max("s1").alias("hi")))
        more_met = [r.hash for r in reps.where("lo <> hi").select("hash").collect()]
        if not more_met:
            break
        met += more_met
        drop(found)
        drop(reps)
    held = [found, reps]  # tables that nothing reads once the removed lines are known

    # Bands of several different lines, of those with the same lines one.
    band = found.where(F.col("kind") == _BAND).groupBy("s1", "s2", "i").agg(F.first(F.struct("blocks", F.col("hash").alias("top"), "members")).alias("b"))
    band = cut(band.select("s1", "s2", "i", "b.*", F.xxhash64("s1", "s2", "i").alias("place")))
    member = band.select("place", F.explode("members").alias("hash"))
    need = cut(member.select("hash").distinct().join(reps, "hash").select("hash", "key", "line"))
    text = rows.select("key", "text").join(_small(need.groupBy("key").agg(F.collect_list(F.struct("line", "hash")).alias("lines")), 100), "key")
    # The text is split once: a plain column of its lines would be put in place within the inner function.
    taken = lambda all_lines: F.transform("lines", lambda x: F.struct(x["hash"], F.element_at(all_lines, x["line"] + 1).alias("text")))
    text = text.select(F.inline(F.element_at(F.transform(F.array(F.split("text", "\n")), taken), 1)))
    # The least line of a wide band is in each of its blocks. Texts and places meet in one shuffle.
    own = member.unionByName(band.where("i > 0").select("place", F.col("top").alias("hash")))
    both = own.select("hash", "place", F.lit(None).cast("string").alias("text")).unionByName(text.select("hash", F.lit(None).cast("long").alias("place"), "text"))
    text = cut(both.groupBy("hash").agg(F.first("text", True).alias("text"), F.collect_set("place").alias("places")))
    held += [band, need, text]
    links = cut(_links(text.select(F.explode("places").alias("place"), "hash", F.col("hash").alias("comp"), "text"), percent, shingle))
    roots = connected_components(links)

    # Wide bands whose lines are still in several components: every pair of their blocks.
    wide = cut(band.where("blocks > 1"))
    held += [links, wide]
    if not wide.isEmpty():
        known = roots.select(F.col("node").alias("hash"), "root")
        broad = wide.select("s1", "s2", "i", "blocks", F.explode("members").alias("hash")).join(known, "hash", "left").select("s1", "s2", "hash", "i", "blocks", F.coalesce("root", "hash").alias("comp"))
        mixed = broad.groupBy("s1", "s2").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s1", "s2")
        pair = broad.join(cut(mixed), ["s1", "s2"]).select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("i"))).alias("j"))
        pair = pair.select(F.xxhash64("s1", "s2", F.least("i", "j"), F.greatest("i", "j")).alias("place"), "hash", "comp")
        more = _links(pair.join(text.select("hash", "text"), "hash"), percent, shingle)
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    roots = cut(roots)
    held.append(roots)
    first = rows.where("text is not null").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("none"))
    first = cut(first.select("key", "first", F.coalesce((F.col("first") < F.col("last")) | F.col("first").isNotNull() & F.col("none"), F.lit(False)).alias("several")))
    alike = reps.where("n > 1").select("hash").unionByName(roots.select(F.col("node").alias("hash"))).distinct()
    alike = cut(alike.join(roots.select(F.col("node").alias("hash"), "root"), "hash", "left").select("hash", F.coalesce("root", "hash").alias("comp")))
    lines = every.join(alike, "hash").select("key", "line", "comp", F.lit(0).cast("long").alias("comp2"))
    if short_lines:
        short = rows.where("text is not null").select("key", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(_short(F.col("x"), min_chars))
        folded = F.translate("x", _UPPER, _UPPER.lower())
        short = short.select(F.xxhash64(folded, F.lit("short")).alias("comp"), F.xxhash64(F.lit("other"), folded).alias("comp2"), "key", "line")
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("key", "line") for f in (F.min, F.max)]
        often = short.groupBy("comp", "comp2").agg(*ends).where("min_key <> max_key or min_line <> max_line").select("comp", "comp2")
        lines = lines.unionByName(short.join(cut(often), ["comp", "comp2"]).select("key", "line", "comp", "comp2").distinct())
    lines = lines.join(first.select("key", "first"), "key")
    lines = cut(lines)
    held += [alike, lines]
    keep = cut(lines.groupBy("comp", "comp2").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key", "line")).alias("keep")))  # a table: a hot component's lines are then split in the join
    gone = lines.join(keep, ["comp", "comp2"]).where("key <> keep.key or line <> keep.line").groupBy("key").agg(F.collect_set("line").alias("gone"))
    done = cut(gone), first.where("several").select("key", "first")
    for table in held:
        drop(table)
    return rows, *done


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_chars: int = 40, shingle: int = SHINGLE, short_lines: bool = False, hash_bits: int = 64) -> DataFrame:
    """docs, with the duplicate lines cut out of the text, and n_lines, n_removed, n_long_kept added.

    Two eligible lines (of min_chars characters or more) are duplicates when percent * |union| <=
    100 * |intersection| for their sets of shingles of so many characters; duplicates of duplicates
    count too, and the first line of a component in order of (id, line number) stays. With
    short_lines, shorter lines that aren't blank are duplicates where equal but for A-Z's case. A
    null text stays null with 0 lines; an empty one has one (short) line. Rows of equal id
    and text are treated alike; a null id comes after all others. Other columns pass through, whatever their names, but for
    the three added ones, which replace columns of their names. Lines of hash_bits that meet
    are told apart by a second hash of 64 bits; fewer than 64 serve tests.
    """
    key = text_key(docs, text_col)
    rows, gone, copies = removed_lines(docs, key, id_col, text_col, percent, min_chars, shingle, short_lines, hash_bits)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), key.alias("key"), F.split(text_col, "\n").alias("all"))
    out = base.join(_small(gone, 120), "key", "left").join(_small(copies, 24), "key", "left")
    long_line = lambda x: F.length(x) >= min_chars
    spared = lambda x: ~long_line(x) & ~_short(x, min_chars) if short_lines else ~long_line(x)
    kept = F.when((F.col("first") < F.col("id")) | F.col("first").isNotNull() & F.col("id").isNull(), F.filter("all", spared)).when(F.col("gone").isNotNull(), F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone")), lambda i: F.element_at("all", i + 1))).otherwise(F.col("all"))
    out = out.withColumn("kept", kept)
    n = F.when(F.col("all").isNull(), 0).otherwise(F.size("all"))
    m = F.when(F.col("all").isNull(), 0).otherwise(F.size("all") - F.size("kept"))
    left = F.coalesce(F.size(F.filter("kept", long_line)), F.lit(0))
    added = {"n_lines": n.cast("long"), "n_removed": m.cast("long"), "n_long_kept": F.when(F.col("all").isNull(), 0).otherwise(left).cast("long")}
    cols = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return out.select(*cols, *[v.alias(k) for k, v in added.items()])
