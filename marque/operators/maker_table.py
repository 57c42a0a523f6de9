"""Manufacturers as a table of any size, found in free text by joins on prefixes.

``makers.parse_name`` holds its names in one regular expression, which suits some hundred of them.
Here the dictionary is a table of keys, and a text is looked up by its prefixes of the lengths
that names have: every one is a key of an equi-join, and the longest that exists wins. Only
distinct beginnings of texts are looked up, not rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marque.functions.columns import name
from marque.functions.text import squeeze, title_case
from marque.operators.makers import Makers
from marque.session import cut

#: Up to this size, estimated, the dictionary or what was found is broadcast.
BROADCAST_BYTES = 32_000_000
#: Bytes of a dictionary row or a found row beside its text, about.
_ROW_BYTES = 200
#: Copies of the dictionary that a shuffled join deals a key's probes to.
SALTS = 32
_ENTRY = "struct<low int, place bigint, text string, maker string, country string>"
_ENTRIES = f"key string, spaced {_ENTRY}, hyphened {_ENTRY}, plain {_ENTRY}, alias struct<maker string, country string>, known string"
#: Aliases come after names of the same length.
_LAST = 1 << 40


def _titled(c: Column) -> Column:
    """In title case where no letter is a capital."""
    return F.when((c == F.lower(c)) & c.rlike(r"\p{L}"), title_case(c)).otherwise(c)


def _with(df: DataFrame, column: str, default: Column) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, default)


def _lookup(namespace: str, c: Column) -> Column:
    return F.concat(F.lit(namespace), c)


@dataclass(frozen=True)
class MakerTable:
    """A dictionary in a folder; ``build`` makes one, ``open`` opens one.

    Results equal ``makers.parse_name`` and ``makers.split_make``, with the country besides; letters are
    compared by lower case. Of names equal but for case, and of equally long ones, the one of the least
    ``place`` counts, then the least.
    """

    entries: DataFrame
    longest: int
    lengths: tuple[int, ...]
    size: int

    @classmethod
    def build(cls, names: DataFrame, aliases: DataFrame, path: str) -> MakerTable:
        """The dictionary of names (name, country, multi_word; may have place and listed) and aliases (alias, name; may have place).

        A name that isn't ``listed`` is only sought, as a multi-word name that is no manufacturer of its own. Null and blank
        names and aliases are left out; of a repeated one the least place counts.
        """
        names = _with(_with(names, "place", F.lit(0)), "listed", F.lit(True)).where("name is not null and trim(name) != ''")
        first = F.min(F.struct(F.col("place").cast("long").alias("place"), F.coalesce("country", F.lit("")).alias("country")))
        names = cut(names.groupBy("name").agg(first.alias("f"), F.max(F.coalesce("multi_word", F.lit(False))).alias("multi_word"), F.max(F.coalesce("listed", F.lit(True))).alias("listed")).select("name", "f.*", "multi_word", "listed"))
        aliases = _with(aliases, "place", F.lit(0)).where("alias is not null and trim(alias) != '' and name is not null")
        aliases = aliases.groupBy("alias").agg(F.min(F.struct(F.col("place").cast("long").alias("place"), "name")).alias("f")).select("alias", "f.place", F.col("f.name").alias("target"))
        listed = names.where("listed").select(F.col("name").alias("maker"), "country")
        aliases = cut(aliases.join(listed.withColumnRenamed("maker", "target"), "target", "left"))

        sought = names.where("multi_word").select(F.col("name").alias("text"), "place", F.lit("spaced").alias("kind"))
        sought = sought.unionByName(aliases.where("contains(alias, ' ')").select(F.col("alias").alias("text"), (F.col("place") + _LAST).alias("place"), F.lit("spaced").alias("kind")))
        sought = sought.unionByName(names.where("listed").select(F.col("name").alias("text"), "place", F.lit("plain").alias("kind")))
        t = squeeze(F.col("text"))
        as_alias = lambda key, out: aliases.select(F.col("alias").alias(key), F.col("target").alias(out))
        sought = sought.withColumns({"_t": t, "_title": _titled(t)}).join(as_alias("_t", "_a"), "_t", "left").join(as_alias("_title", "_b"), "_title", "left")
        sought = sought.join(listed.select(F.col("maker").alias("_t"), F.lit(True).alias("_known")), "_t", "left")
        maker = F.coalesce("_a", "_b", F.when(F.col("_known"), F.col("_t")), "_title")
        sought = sought.withColumn("maker", maker).join(listed, "maker", "left")
        entry = F.struct((-F.length("text")).alias("low"), "place", "text", "maker", F.coalesce("country", F.lit("")).alias("country")).cast(_ENTRY)
        lower = F.lower("text")
        spaced = F.col("kind") == "spaced"
        rows = sought.select(_lookup("l", lower).alias("key"), F.when(spaced, entry).alias("spaced"), F.lit(None).cast(_ENTRY).alias("hyphened"), F.when(~spaced, entry).alias("plain"))
        rows = rows.unionByName(sought.where(spaced).select(_lookup("h", F.replace(lower, F.lit(" "), F.lit("-"))).alias("key"), F.lit(None).cast(_ENTRY).alias("spaced"), entry.alias("hyphened"), F.lit(None).cast(_ENTRY).alias("plain")))
        exact = aliases.select(_lookup("x", F.col("alias")).alias("key"), F.struct(F.col("target").alias("maker"), "country").alias("alias"))
        exact = exact.unionByName(listed.select(_lookup("x", F.col("maker")).alias("key"), F.col("country").alias("known")), allowMissingColumns=True)
        rows = rows.unionByName(exact, allowMissingColumns=True)
        rows.groupBy("key").agg(*[F.min(c).alias(c) for c in ("spaced", "hyphened", "plain", "alias", "known")]).write.mode("overwrite").parquet(path)
        return cls.open(names.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MakerTable:
        entries = spark.read.schema(_ENTRIES).parquet(path)
        n = F.length("key") - 1
        about = entries.agg(F.max(n).alias("longest"), F.collect_set(F.when(F.startswith("key", F.lit("l")), n)).alias("lengths"), F.sum(F.octet_length("key") * 4 + _ROW_BYTES).alias("size")).first()
        return cls(entries, about["longest"] or 0, tuple(sorted(about["lengths"])), about["size"] or 0)

    @classmethod
    def of(cls, spark: SparkSession, makers: Makers, path: str) -> MakerTable:
        """The table of a configuration."""
        multi = {n: i for i, n in enumerate(makers.multi_word)}
        listed = [(n, country, n in multi, i, True) for i, (n, country) in enumerate(makers.countries.items())]
        only_sought = [(n, "", True, i, False) for n, i in multi.items() if n not in makers.countries]
        names = spark.createDataFrame(listed + only_sought, "name string, country string, multi_word boolean, place long, listed boolean")
        return cls.build(names, spark.createDataFrame([(a, n, i) for i, (a, n) in enumerate(makers.aliases.items())], "alias string, name string, place long"), path)

    def _probes(self, slots: str) -> Column:
        """What a beginning (columns head and tail) is looked up by: structs of slot, length used and key.

        Slots: p a prefix, i a name after the first word, w the first word, t the whole text (each also in title case, as W and T), h the text with hyphens.
        """
        head, tail = F.col("head"), F.col("tail")
        word = F.split_part(head, F.lit(" "), F.lit(1))
        row = lambda slot, at, key: F.struct(F.lit(slot).alias("slot"), at.cast("int").alias("at"), key.alias("key"))
        ks = F.array(*[F.lit(k) for k in self.lengths]).cast("array<int>")
        cut_at = lambda slot, c, test: F.transform(F.filter(ks, test), lambda k: row(slot, k, _lookup("l", F.lower(F.substr(c, F.lit(1), k)))))
        nothing = F.lit(0)
        every = {
            "p": cut_at("p", head, lambda k: k <= F.length(head)),
            "i": cut_at("i", tail, lambda k: (k == F.length(tail)) | ((k < F.length(tail)) & (F.substr(tail, k + 1, F.lit(1)) == " "))),
            "w": F.array(row("w", nothing, _lookup("x", word)), row("W", nothing, _lookup("x", _titled(word)))),
            "t": F.array(row("t", nothing, _lookup("x", head)), row("T", nothing, _lookup("x", _titled(head)))),
            "h": F.array(row("h", nothing, _lookup("h", F.replace(F.lower(head), F.lit(" "), F.lit("-"))))),
        }
        return F.concat(*[every[s] for s in slots])

    def _found(self, heads: DataFrame, slots: str) -> DataFrame:
        """A row for each beginning with a hit: best spaced name, best plain name, and the exact hits of word and text."""
        probes = heads.select("head", "tail", F.inline(self._probes(slots)))
        if self.size <= BROADCAST_BYTES:
            hits = probes.join(F.broadcast(self.entries), "key")
        else:
            salted = self.entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            hits = probes.withColumn("salt", F.pmod(F.xxhash64("head", "tail"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
        slot = F.col("slot")

        def best(*ways: tuple[str, str]) -> Column:
            out = F.lit(None)
            for i, (s, column) in enumerate(ways):
                e = F.col(column)
                out = F.when((slot == s) & e.isNotNull(), F.struct(e["low"].alias("low"), e["place"].alias("place"), e["text"].alias("text"), F.lit(i).alias("way"), e["maker"].alias("maker"), e["country"].alias("country"), F.col("at").alias("at"))).otherwise(out)
            return F.min(out)

        aggs = [best(("p", "spaced"), ("h", "hyphened")).alias("spaced"), best(("p", "plain"), ("i", "plain")).alias("plain")]
        for s in "wWtT":
            aggs += [F.max(F.when(slot == s, F.col("alias"))).alias(f"alias{ord(s)}"), F.max(F.when(slot == s, F.col("known"))).alias(f"known{ord(s)}")]
        return hits.groupBy("head", "tail").agg(*aggs)

    def _matched(self, df: DataFrame, column: str, into: str, slots: str) -> DataFrame:
        """df as a struct _row, its text squeezed as _t, and what was found for it."""
        t, keep = F.col("_t"), self.longest + 1
        texts = df.select(F.struct(*[name(c) for c in df.columns if c.lower() != into.lower()]).alias("_row"), squeeze(F.coalesce(name(column), F.lit(""))).alias("_t"))
        word = F.split_part(t, F.lit(" "), F.lit(1))
        tail = F.when(word.rlike(r"(?U)^[\w\-.]+$"), F.substr(t, F.length(word) + 2, F.lit(keep))).otherwise(F.lit(""))
        texts = texts.withColumns({"head": F.substr(t, F.lit(1), F.lit(keep)), "tail": tail if "i" in slots else F.lit("")})
        heads = cut(texts.where("_t != ''").select("head", "tail").distinct())
        found = cut(self._found(heads, slots))
        small = found.count() * (_ROW_BYTES + 16 * keep) <= BROADCAST_BYTES
        return texts.join(F.broadcast(found) if small else found, ["head", "tail"], "left")

    @staticmethod
    def _normal(text: Column, slot: str) -> tuple[Column, Column]:
        """The canonical name of a text that was looked up exactly, and its country (null if it's no manufacturer)."""
        alias, known = (lambda s: F.col(f"alias{ord(s)}")), (lambda s: F.col(f"known{ord(s)}"))
        low, title = slot, slot.upper()
        maker = F.coalesce(alias(low)["maker"], alias(title)["maker"], F.when(known(low).isNotNull(), text), _titled(text))
        country = F.when(alias(low).isNotNull(), alias(low)["country"]).when(alias(title).isNotNull(), alias(title)["country"]).otherwise(F.coalesce(known(low), known(title)))
        return maker, country

    def parse_names(self, df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
        """df with the struct ``into`` (manufacturer, model, country) of a vehicle's full name; an earlier column of that name goes.

        As ``makers.parse_name``; null and blank text gives blanks, an unknown manufacturer a blank country. Rows stay as they
        are, repeated ones too. df is read twice: for its distinct beginnings, which are shuffled, and for its rows.
        Where too many beginnings were found to broadcast, rows are shuffled by them; those of a text that
        very many rows share are split by AQE's skew join.
        """
        t = F.col("_t")
        word = F.split_part(t, F.lit(" "), F.lit(1))
        rest = F.substr(t, F.length(word) + 2)
        triple = lambda a, b, c: F.struct(a.alias("manufacturer"), b.alias("model"), F.coalesce(c, F.lit("")).alias("country"))
        blank = F.lit("")
        after = lambda at: F.regexp_replace(F.trim(F.substr(t, at + 1)), r"^[\s\-/]+", "")
        s, p = F.col("spaced"), F.col("plain")
        infix = F.trim(F.concat_ws(" ", word, F.nullif(F.trim(F.substr(rest, p["at"] + 1)), blank)))
        maker, country = self._normal(word, "w")
        out = F.when(t == "", triple(blank, blank, blank)).when(s.isNotNull(), triple(s["maker"], after(s["at"]), s["country"]))
        out = out.when(p["way"] == 0, triple(p["maker"], after(p["at"]), p["country"])).when(p["way"] == 1, triple(p["maker"], infix, p["country"]))
        out = out.when(word.rlike(r"^\d+$") & (rest != ""), triple(blank, t, blank)).otherwise(triple(maker, rest, country))
        return self._matched(df, column, into, "piw").select("_row.*", out.alias(into))

    def split_makes(self, df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
        """df with the struct ``into`` (manufacturer, model, country) of a make field that may hold part of the model, as ``makers.split_make``. Edges as in ``parse_names``."""
        t = F.col("_t")
        word = F.split_part(t, F.lit(" "), F.lit(1))
        triple = lambda a, b, c: F.struct(a.alias("manufacturer"), b.alias("model"), F.coalesce(c, F.lit("")).alias("country"))
        blank = F.lit("")
        s = F.col("spaced")
        whole, whole_country = self._normal(t, "t")
        first, first_country = self._normal(word, "w")
        out = F.when(t == "", triple(blank, blank, blank)).when(whole_country.isNotNull(), triple(whole, blank, whole_country))
        out = out.when(s["way"] == 0, triple(s["maker"], F.trim(F.substr(t, s["at"] + 1)), s["country"])).when(s["way"] == 1, triple(s["maker"], blank, s["country"]))
        out = out.when(first_country.isNotNull(), triple(first, F.substr(t, F.length(word) + 2), first_country)).otherwise(triple(whole, blank, F.lit("")))
        return self._matched(df, column, into, "pwth").select("_row.*", out.alias(into))
