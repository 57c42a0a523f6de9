"""Search by an inverted index that is kept as a table.

``postings`` has a row for each piece of a token, with the piece's ids. A task packs the rows that it reads, some ten
thousand at a time, into pieces, so that what is shuffled are pieces and not single postings, and no task or row grows
with a token. Pieces are dealt by ranges of the token into folders, a token of many ids to as many ranges as it fills;
``fences`` has the first and last token of each folder, ``about`` what the ids are. A word is looked up, and a prefix
as a range of tokens, by reading the fences and the one or few folders that they name; the
rows of the catalog come by a semi join on the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.operators.store import tokens, with_derived
from marque.session import cut, tidy

if TYPE_CHECKING:
    import pyarrow as pa

#: Ids in a piece of a token's postings, at most.
PIECE = 1_000
#: Postings that a task sorts, about; of a folder, where the caller doesn't say how many folders there are.
FOLDER_POSTINGS = 5_000_000
#: Rows, and bytes of them about, that a task packs at a time.
PACKED_ROWS, PACKED_BYTES = 65_536, 32_000_000
#: Rows, about, whose tokens set the bounds of the ranges, and bounds kept for each. They decide how evenly pieces are dealt and nothing else.
BOUND_ROWS, RANGE_BOUNDS = 20_000, 200
_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: After every character of a token.
_END = "\U0010ffff"


def words_of(spark: SparkSession, text: str) -> list[str]:
    """The words of a search, folded as the index's tokens are."""
    return spark.sql("SELECT * FROM VALUES (:text) AS v(t)", args={"text": text}).select(tokens(F.col("t"))).first()[0] or []


def _packing(bounds: list[str], ranges: int, piece: int, most_rows: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (id, tokens) to (range, token, piece, ids), each row's distinct tokens only.

    bounds: tokens in order, as often as they are met; ``ranges`` of them have equally many each. A token that is there
    more than once has its pieces dealt over the ranges of all its places. Pieces are numbered through the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40
        often = Counter(bounds)

        def changes(x):
            return np.flatnonzero(np.append(True, x[1:] != x[:-1]))

        def packed(held):
            nonlocal made
            ids, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            words = lists.flatten()
            rows = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            if words.null_count:
                rows, words = rows[pc.is_valid(words).to_numpy(zero_copy_only=False)], words.drop_null()
            if not len(words):
                return
            coded = words.dictionary_encode()
            both = np.sort(coded.indices.to_numpy().astype(np.int64) * len(ids) + rows)
            codes, rows = np.divmod(both[changes(both)], len(ids))
            firsts = changes(codes)
            nth = np.arange(len(codes)) - np.repeat(firsts, np.diff(np.append(firsts, len(codes))))
            starts = np.flatnonzero(nth % piece == 0)
            of = codes[starts]
            numbers = made + np.arange(len(starts))
            made += len(starts)
            known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            low, places = (np.array(x) for x in ([bisect_left(bounds, w) for w in known], [often.get(w, 1) for w in known]))
            at = np.minimum(low[of] + numbers % places[of], max(len(bounds) - 1, 0))
            ends = pa.array(np.append(starts, len(codes)), pa.int32())
            columns = [pa.array(at * ranges // max(len(bounds), 1), pa.int32()), coded.dictionary.take(pa.array(of)), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(ends, ids.take(pa.array(rows)))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "token", "piece", "ids"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most_rows or sum(b.nbytes for b in held) >= most_bytes:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


@dataclass(frozen=True)
class SearchIndex:
    """An index in a folder; ``build`` makes one, the constructor opens one.

    It stays as it was built: after the catalog changes, build it anew.
    """

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, catalog: DataFrame, path: str, id_col: str = "car_id", folders: int | None = None, piece: int = PIECE, unique: bool = False) -> SearchIndex:
        """The index of a catalog's ids by the tokens of car_id, manufacturer and model.

        Rows without an id or without tokens aren't in it; rows that share an id are one document. Whole numbers are kept
        as such, other ids as text. unique: the caller knows that no two rows share an id, so that a row that is found needs no test.
        The tokens of some rows bound the ranges; then the catalog is read once, and its pieces are shuffled once, by those ranges;
        a folder is one range or, where it holds more than FOLDER_POSTINGS, several in a row.
        """
        rows = catalog if "search_tokens" in catalog.columns else with_derived(catalog)
        spark = catalog.sparkSession
        kind = "bigint" if dict(rows.select(name(id_col)).dtypes)[id_col] in _WHOLE else "string"
        kept = rows.select(name(id_col).cast(kind).alias("id"), F.col("search_tokens").alias("tokens")).where("id is not null")
        with tidy(spark):
            every = max(1, kept.count() // BOUND_ROWS)
            some = kept.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
            bounds = sorted(w for r in some.select("tokens").collect() for w in {*(r[0] or [])} - {None})
        total = every * len(bounds)
        n = folders or max(1, -(-total // FOLDER_POSTINGS))
        each = max(1, -(-total // (n * FOLDER_POSTINGS)))
        bounds = bounds[:: max(1, len(bounds) // (n * each * RANGE_BOUNDS))]
        pieces = kept.mapInArrow(_packing(bounds, n * each, piece, PACKED_ROWS, PACKED_BYTES), f"range int, token string, piece long, ids array<{kind}>")
        dealt = pieces.repartitionById(n * each, "range").withColumn("folder", (F.col("range") / each).cast("int")).drop("range")
        with tidy(spark):
            dealt.sortWithinPartitions("folder", "token", "piece").write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/postings")
            written = spark.read.schema(f"token string, piece long, ids array<{kind}>, folder int").parquet(f"{path}/postings")
            fences = written.groupBy("folder").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count("*").alias("pieces"))
            fences.coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")
            spark.range(1).coalesce(1).select(F.lit(id_col).alias("id_col"), F.lit(kind).alias("kind"), F.lit(unique).alias("unique")).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    @cached_property
    def about(self) -> Row:
        """The ids' column, their kind, and whether each is one row's alone."""
        return self.spark.read.parquet(f"{self.path}/about").first()

    def _ranges(self, text: str) -> list[tuple[str, str]]:
        """Of each word the first and the last token sought: itself, or for the last word all that begin with it."""
        words = words_of(self.spark, text)
        return [*((w, w) for w in dict.fromkeys(words[:-1])), *((w, w + _END) for w in words[-1:])]

    def _folders(self, ranges: list[tuple[str, str]]) -> list[int]:
        """Folders whose range of tokens meets one that is sought."""
        fences = self.spark.read.parquet(f"{self.path}/fences")
        meets = F.lit(False)
        for low, high in ranges:
            meets |= (F.col("low") <= high) & (F.col("high") >= low)
        return [r["folder"] for r in fences.where(meets).select("folder").collect()]

    def _postings(self, ranges: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/postings/folder={f}" for f in self._folders(ranges)]
        schema = f"token string, piece long, ids array<{self.about['kind']}>"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def files(self, text: str) -> list[str]:
        """The files of postings that a search of the text reads."""
        return sorted(self._postings(self._ranges(text)).inputFiles())

    def ids(self, text: str) -> DataFrame:
        """(id) of the rows that hold all words of the text, the last as a prefix. Text without words finds nothing.

        Reads only the folders of the words. An id counts once for each word: one aggregate over the words'
        postings, with as many rows as the words have ids.
        """
        ranges = self._ranges(text)
        rows = self._postings(ranges)
        sought = F.lit(False)
        tests: list[Column] = []
        for low, high in ranges:
            tests.append(F.col("token") == low if high == low else (F.col("token") >= low) & (F.col("token") < high))
            sought |= tests[-1]
        found = rows.where(sought).select(F.explode("ids").alias("id"), *[t.alias(f"w{i}") for i, t in enumerate(tests)])
        if len(ranges) <= 1:
            return found.select("id").distinct()
        seen = found.groupBy("id").agg(*[F.max(f"w{i}").alias(f"w{i}") for i in range(len(ranges))])
        every = F.lit(True)
        for i in range(len(ranges)):
            every &= F.col(f"w{i}")
        return seen.where(every).select("id")

    def search(self, rows: DataFrame, text: str) -> DataFrame:
        """The rows whose id the search finds. What the ids take, known as they are found, decides whether they are broadcast."""
        return rows.join(self.ids(text).withColumnRenamed("id", "_id"), self._of(), "left_semi")

    def search_each(self, rows: DataFrame, texts: Iterable[str]) -> DataFrame:
        """The rows with each text (``search``) that finds their id: rows are read, and shuffled where they must be, once for all texts."""
        return rows.join(self.hits(texts), self._of()).drop("_id")

    def _of(self) -> Column:
        return name(self.about["id_col"]).cast(self.about["kind"]) == F.col("_id")

    def hits(self, texts: Iterable[str]) -> DataFrame:
        """(search, _id) of each text and what it finds, stored, so that what finding them shuffled is gone."""
        each = [self.ids(t).select(F.lit(t).alias("search"), F.col("id").alias("_id")) for t in dict.fromkeys(texts)]
        return cut(reduce(DataFrame.unionByName, each, self.spark.createDataFrame([], f"search string, _id {self.about['kind']}")))
