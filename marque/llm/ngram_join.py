"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The incidence matrix is never expanded into rows. It is cut into column blocks (n-gram
hashes) that travel packed (``dealing``), and the work is discarding:

1. Column blocks: an n-gram that only one text has adds to no overlap. Each block counts,
   for every text, the columns it shares with another one. A text whose shared columns are
   fewer than 75 % of its set can't reach the bound with anything and is dropped; for most
   text this leaves the near copies alone.
2. Row blocks: the remaining texts, grouped by a two-row MinHash and split by hash into
   blocks of bounded size, are multiplied (A_b A_b^T over column slices). Pairs of unlike
   sizes are skipped. Links become a spanning forest and components by union-find.
3. The columns are counted again, now by component: a text is dropped when fewer than 75 %
   of its set lie in texts of other components, as no link can then leave its component.
   2 and 3 alternate; they only have to make the rest small.
4. The rest is settled exactly. Texts that share a column of their prefixes (rarest columns
   first; any linked pair shares one) form candidate clusters, and every two row blocks of
   a cluster are multiplied. Nothing is capped, and no link between components is lost.

Texts that are byte for byte equal are one row throughout.
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
from marque.llm.components import connected_components
from marque.llm.dealing import LOCAL, SCHEMA, Deal, Packed, Row, batched, grouped, united
from marque.llm.hashing import BLANK, hashed_words, lower_ascii, mix, shingles
from marque.llm.shared import cut, drop, text_bytes, text_key

#: Text bytes for each column block (about 1.2 million entries) and rows of a row block.
BLOCK_BYTES = 8_000_000
ROW_BLOCK = 768
#: Text bytes and texts packed together.
PART_BYTES = 4_000_000
PART_TEXTS = 60_000
#: Text bytes hashed at once: some 60 bytes of a worker's memory for each.
HASH_BYTES = 250_000
#: Texts that a task remembers.
SEEN = 500_000
#: Columns multiplied at once in a row block.
COLUMN_SLICE = 4096
#: Passes of steps 2 and 3 before step 4, and the texts that go to step 4 without. More passes only move work from 4 to 2.
PASSES, FEW = 2, 4 * ROW_BLOCK

#: Kinds of rows: texts; their columns; columns that another text has too.
_HOME, _ENTRY, _SHARED = range(3)
_TEXTS = "key long, comp long, n long, tokens binary, dfs binary"

Batches = Iterator[pa.RecordBatch]


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest possible overlap of a linked pair for a set of n: ceil(percent / 100 * n)."""
    return (n * percent + 99) // 100


def _place(deal: Deal):
    return lambda kind, e: deal.place(e.cols[0]) if kind == _ENTRY else deal.homes(e.who[e.of])


def _sent(deal: Deal, part: int, key: np.ndarray, comp: np.ndarray, size: np.ndarray, text: np.ndarray, token: np.ndarray) -> Iterator[Row]:
    """A part's texts, and their columns with the text's component."""
    who = np.uint64(part << int(LOCAL)) + np.arange(len(key), dtype=np.uint64)
    texts = Packed(who, np.arange(len(key)), [key.view(np.uint64), comp.view(np.uint64), size])
    yield from deal.rows(_HOME, part, deal.homes(who), texts)
    columns = deal.rows(_ENTRY, part, deal.place(token), Packed(who, text, [token], (comp.view(np.uint64),)))
    del text, token  # rows sorts a copy
    yield from columns


def _first(docs: DataFrame, deal: Deal, n: int) -> DataFrame:
    """Step 1's entries of (key, text binary). A text seen before by the task, among its last SEEN, adds nothing."""

    def made(batches: Batches) -> Iterator[Row]:
        part, fold = TaskContext.get().partitionId() << 24, lower_ascii()
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        bulk = own = 0

        def out() -> Iterator[Row]:
            first = np.cumsum([0, *[len(k) for k, *_ in held]])
            key, size, token = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
            text = np.concatenate([h[2] + a for h, a in zip(held, first, strict=False)])
            held.clear()
            return _sent(deal, part, key, key, size, text, token)

        for batch in batches:
            for some in slices(batch, _lengths(batch.column(1)), HASH_BYTES):
                fresh = {}
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if t and k not in seen:
                        fresh[k] = t
                if not fresh:
                    continue
                seen.update(fresh)
                own += len(fresh)
                bulk += sum(map(len, fresh.values()))
                h, counts = hashed_words(list(fresh.values()), fold, BLANK)
                text, token, size = shingles(h, counts, n)
                held.append((np.array(list(fresh), np.int64), size, text, token))
                if bulk > PART_BYTES or own > PART_TEXTS:
                    yield from out()
                    part, bulk, own = part + 1, 0, 0
                if len(seen) > SEEN:
                    seen.clear()
        if held:
            yield from out()

    return docs.mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


def _again(texts: DataFrame, deal: Deal) -> DataFrame:
    """Entries of step 3, of texts (key, comp, n, tokens)."""

    def made(batches: Batches) -> Iterator[Row]:
        part = TaskContext.get().partitionId() << 24
        for batch in batches:
            for b in slices(batch, _lengths(batch.column(3))):
                toks = [np.frombuffer(x, "<u8") for x in b.column(3).to_pylist()]
                key, comp, size = (b.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 2))
                yield from _sent(deal, part, key, comp, size, np.repeat(np.arange(len(toks)), [len(x) for x in toks]), np.concatenate(toks))
                part += 1

    return texts.select("key", "comp", "n", "tokens").mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


def _lengths(column: pa.Array) -> list[int | None]:
    return pc.binary_length(column).to_pylist()


def _count_columns(dealt: DataFrame, deal: Deal, by_comp: bool) -> DataFrame:
    """The entries whose column is shared, with the column's number of texts, sent home; texts pass through.

    Shared: by two texts, or with by_comp by texts of two components.
    """

    def block(src: int, e: Packed) -> Iterator[Row]:
        token = e.cols[0]
        if by_comp:
            comp = e.about[0][e.of]
            order = np.lexsort((comp, token))
        else:
            order = np.argsort(token)
        t = token[order]
        new = np.r_[True, t[1:] != t[:-1]]
        group = np.cumsum(new) - 1
        df = np.bincount(group)
        if by_comp:
            c = comp[order]
            kinds = np.bincount(group, np.r_[True, new[1:] | (c[1:] != c[:-1])])
            hit = (kinds > 1)[group]
        else:
            hit = (df > 1)[group]
        at, df = order[hit], df[group[hit]]
        del group, t, new
        back = np.argsort(e.of[at], kind="stable")  # by text: what is sent compresses well
        at, df = at[back], df[back]
        out = Packed(e.who, e.of[at], [token[at], np.minimum(df, 65535)])
        yield from deal.rows(_SHARED, src, deal.homes(e.who)[out.of], out)

    def made(batches: Batches) -> Iterator[Row]:
        by = grouped(batches)
        while by:
            task, kinds = by.popitem()
            own = kinds.pop(_ENTRY, [])
            yield from ((task, kind, src, data) for kind, rows in kinds.items() for src, data in rows)
            if own:
                yield from block(task, united([d for _, d in own]))

    return dealt.mapInArrow(tidy(lambda batches: batched(made(batches))), SCHEMA)


def _gather(dealt: DataFrame, percent: int) -> DataFrame:
    """Per text: its shared columns, or null where they are too few for any link."""

    def run(batches: Batches) -> Batches:
        by = grouped(batches)
        while by:
            _, kinds = by.popitem()
            home = united([d for _, d in kinds[_HOME]])
            place = np.argsort(home.of)  # a text has one entry
            key, comp, size = (c[place] for c in home.cols)
            entries = [Packed.read(d) for _, d in kinds.pop(_SHARED, [])]
            text = np.concatenate([np.zeros(0, np.int64), *[np.searchsorted(home.who, e.who)[e.of] for e in entries]])
            token, df = (np.concatenate([np.zeros(0, np.uint64), *[e.cols[i] for e in entries]]) for i in (0, 1))
            del entries, kinds
            order = np.lexsort((token, text))
            text, token, df = text[order], token[order], df[order].astype("<u2")
            bounds = np.searchsorted(text, np.arange(len(key) + 1)).tolist()
            need = _least(size.astype(np.int64), percent).tolist()
            keep = [least > 0 and b - a >= least for a, b, least in zip(bounds, bounds[1:], need, strict=False)]
            tokens = [token[a:b].tobytes() if k else None for a, b, k in zip(bounds, bounds[1:], keep, strict=False)]
            dfs = [df[a:b].tobytes() if k else None for a, b, k in zip(bounds, bounds[1:], keep, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(comp.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(tokens, pa.binary()), pa.array(dfs, pa.binary())], ["key", "comp", "n", "tokens", "dfs"])

    return dealt.mapInArrow(tidy(run), _TEXTS)


def _shared(sent: DataFrame, deal: Deal, by_comp: bool, percent: int) -> DataFrame:
    """texts with the columns that they share, of packed texts and entries."""
    place = _place(deal)
    return cut(_gather(deal.dealt(_count_columns(deal.dealt(sent, place), deal, by_comp), place), percent))


def forest(comps: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a row block as (component, component) of a spanning forest, by products over column slices."""
    order = np.argsort(sizes, kind="stable")
    sizes, comps, sets = sizes[order], comps[order], [sets[i] for i in order]
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    overlap = np.zeros((m, m), np.float32)
    wide = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, wide, COLUMN_SLICE):
        i, j = np.searchsorted(col, (a, a + COLUMN_SLICE))
        rows = np.unique(row[i:j])
        dense = np.zeros((len(rows), min(COLUMN_SLICE, wide - a)), np.float32)
        dense[np.searchsorted(rows, row[i:j]), col[i:j] - a] = 1
        overlap[np.ix_(rows, rows)] += dense @ dense.T  # exact: counts stay far below 2**24
    n = sizes.astype(np.int64)
    o = overlap.astype(np.int64)
    linked = 100 * o >= percent * (n[:, None] + n[None, :] - o)
    label = np.arange(m)
    while True:  # least label among linked rows, then a jump, until nothing moves
        new = np.minimum(label, np.where(linked, label[None, :], m).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    got = {(int(comps[r]), int(comps[i])) for i, r in enumerate(label.tolist()) if comps[r] != comps[i]}
    return sorted(got)


def _row_blocks(texts: DataFrame, percent: int, turn: int) -> DataFrame:
    """Step 2: links (a, b) between components of texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [mix(np.array([2 * turn + i + 1], np.uint64))[0] for i in (0, 1)]
        for b in batches:
            sig = []
            for x in b.column(1).to_pylist():
                t = np.frombuffer(x, "<u8")
                sig.append(int(mix(np.array([mix(t ^ s).min() for s in salts], np.uint64)[:1] ^ mix(t ^ salts[1]).min())[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.int64())], ["key", "sig"])

    sigs = cut(texts.select("key", "tokens").mapInArrow(tidy(sign), "key long, sig long"))
    many = sigs.groupBy("sig").count().where("count > 1")
    where = sigs.join(many, "sig").select("key", F.xxhash64("sig", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("count") / ROW_BLOCK).cast("long"))).alias("place"))
    rows = texts.join(where, "key").select("place", "key", "comp", "n", "tokens")
    return _products(rows, percent)


def _products(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from the product of each row block; rows: place, key, comp, n, tokens."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(own: list[tuple]) -> pa.RecordBatch | None:
            if len({r[2] for r in own}) < 2:
                return None
            got = forest(*(np.array([r[i] for r in own], np.int64) for i in (2, 3)), [np.frombuffer(r[4], "<u8") for r in own], percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"]) if got else None

        own: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own and own[-1][0] != r[0]:
                    if (out := links(own)) is not None:
                        yield out
                    own = []
                own.append(r)
        if own and (out := links(own)) is not None:
            yield out

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(product), "a long, b long")


def _exact_blocks(texts: DataFrame, percent: int) -> DataFrame:
    """Step 4: every link between different components as links (a, b) between them."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, comp, tok = [], [], []
            for k, c, m, x, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, df = np.frombuffer(x, "<u8"), np.frombuffer(d, "<u2")
                t = t[np.lexsort((t, df))][: len(t) - int(_least(np.int64(m), percent)) + 1]
                key += [k] * len(t)
                comp += [c] * len(t)
                tok.append(t.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(comp, pa.int64()), pa.array(np.concatenate(tok), pa.int64())], ["key", "comp", "token"])

    p = cut(texts.select("key", "comp", "n", "tokens", "dfs").mapInArrow(tidy(prefix), "key long, comp long, token long"))
    mixed = p.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("key").alias("to")).where("lo < hi").select("token", "to")
    mixed = cut(mixed)  # a table: a hot column's texts are then split in the join
    near = cut(connected_components(p.join(mixed, "token").select(F.col("key").alias("a"), F.col("to").alias("b"))))
    size = near.groupBy("root").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("blocks"))
    place = near.join(size, "root").select(F.col("node").alias("key"), "root", "blocks", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("i"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("i")))
    place = place.select("key", "root", "i", F.explode(other).alias("j")).select("key", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("place"))
    return _products(texts.join(place, "key").select("place", "key", "comp", "n", "tokens"), percent)


def _merged(known: DataFrame | None, roots: DataFrame) -> DataFrame:
    """(node, root) of all components so far; the nodes of roots are components of known."""
    if known is None:
        return roots
    moved = known.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(roots.join(known.select("node"), "node", "left_anti")))


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key of the text; label: key, n, comp, the text's component)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_key(docs, text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    total = text_bytes(docs, text_col)
    deal = Deal.of(spark, max(12, -(-total // BLOCK_BYTES)))
    texts = _shared(_first(rows.select("key", "text"), deal, n), deal, False, percent)
    sizes = cut(texts.groupBy("key").agg(F.max("n").alias("n")))
    rest = cut(texts.where("tokens is not null").groupBy("key").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    drop(texts)
    known: DataFrame | None = None
    for turn in range(PASSES + 1):
        mass = rest.agg(F.count("*"), F.sum(F.octet_length("tokens"))).first()
        if not mass[0]:
            break
        # Step 3, and on the first turn the same among different texts: copies in several tasks counted as texts of their own.
        own = Deal.of(spark, max(12, -(-mass[1] // (8 * BLOCK_BYTES // 6))))
        fewer = _shared(_again(rest, own), own, True, percent)
        drop(rest)
        rest = fewer.where("tokens is not null")
        settled = turn == PASSES or mass[0] <= FEW
        links = _exact_blocks(rest, percent) if settled else _row_blocks(rest, percent, turn)
        roots = cut(connected_components(links))
        if settled:
            known = _merged(known, roots)
            drop(rest)
            break
        moved = rest.select("key", "comp").join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
        known = _merged(known, roots)
        now = cut(rest.drop("dfs").join(moved.withColumnRenamed("comp", "now"), "key").select("key", F.col("now").alias("comp"), "n", "tokens"))
        drop(rest)
        rest = now
    label = sizes if known is None else sizes.join(known.select(F.col("node").alias("key"), "root"), "key", "left")
    label = label.select("key", "n", (F.coalesce("root", "key") if known is not None else F.col("key")).alias("comp"))
    return rows.select("id", "key"), label


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (least id reachable by links, its own included).

    A set is the distinct n-word shingles of the text (A-Z lower-cased, words split at
    ASCII white space; a text of fewer words is one shingle). Two rows link when
    100 * |intersection| >= percent * |union|. A null, empty or blank text has an empty set
    and is linked with nothing, not even its copies. Rows with a null id keep a null
    component unless linked. Extra columns are not read. Shingles are compared by 64-bit hash.
    """
    rows, label = _labelled(docs, id_col, text_col, n, percent)
    ids = rows.groupBy("key").agg(F.min("id").alias("id"))
    label = cut(label.join(ids, "key"))
    least = cut(label.groupBy("comp").agg(F.min("id").alias("least")))  # a table: a hot component's texts are then split in the join
    label = label.join(least, "comp").select("key", "n", "least")
    out = rows.join(label, "key", "left")
    got = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), got.alias("n_shingles"), F.when(got > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(id, key of the text) of the rows that aren't the first of their component, in order of id, then key.

    Components are those of jaccard_components, of texts: an id that repeats with unlike texts joins nothing. A null
    id comes first. Rows that repeat an id and text count as one.
    """
    rows, label = _labelled(docs, id_col, text_col, n, percent)
    linked = cut(rows.distinct().join(label.select("key", "comp"), "key"))
    first = cut(linked.groupBy("comp").agg(F.min(F.struct("id", "key")).alias("first")))
    return linked.join(first, "comp").where(~F.struct("id", "key").eqNullSafe(F.col("first"))).select("id", "key")
