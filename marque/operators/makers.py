"""Manufacturer names: canonical forms, countries, and finding them in free text.

The dimension comes from a YAML or JSON file (``manufacturers`` with countries, ``aliases``,
``multi_word_manufacturers``, ``country_names``) or from Python dicts. It's a configuration of some
hundred names, so lookups are literal maps and alternations, without joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from marque.functions.classify import mapped
from marque.functions.columns import let
from marque.functions.text import squeeze, title_case


@dataclass(frozen=True)
class Makers:
    countries: Mapping[str, str]  # canonical name -> country code
    aliases: Mapping[str, str] = field(default_factory=dict)
    multi_word: tuple[str, ...] = ()
    country_names: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Makers:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                data = json.load(f)
            else:
                import yaml

                data = yaml.safe_load(f)
        return cls.of(data)

    @classmethod
    def of(cls, data: Mapping) -> Makers:
        makers = data.get("manufacturers", {})
        return cls({k: (v.get("country", "") if isinstance(v, Mapping) else v or "") for k, v in makers.items()}, data.get("aliases", {}), tuple(data.get("multi_word_manufacturers", ())), data.get("country_names", {}))

    @property
    def spaced(self) -> list[str]:
        """Names to try first: multi-word ones and aliases with a space, longest first."""
        return sorted(dict.fromkeys([*self.multi_word, *(a for a in self.aliases if " " in a)]), key=len, reverse=True)

    @property
    def canonical(self) -> list[str]:
        return sorted(self.countries, key=len, reverse=True)


def _lookup(c: Column, table: Mapping[str, str]) -> Column:
    return mapped(c, table) if table else F.lit(None).cast("string")


def normalize(c: Column, makers: Makers) -> Column:
    """The canonical name: an alias of the text or of its title case, else the text (title case if all lower)."""
    def find(t: Column) -> Column:
        lower = (t == F.lower(t)) & t.rlike(r"\p{L}")
        known = F.when(t.isin(*makers.countries), t) if makers.countries else F.lit(None).cast("string")
        title = let(F.when(lower, title_case(t)).otherwise(t), lambda x: F.coalesce(_lookup(x, makers.aliases), known, x))
        return F.coalesce(_lookup(t, makers.aliases), title)

    return let(squeeze(F.coalesce(c, F.lit(""))), find)


def country_of(c: Column, makers: Makers) -> Column:
    """The country code of a name, blank if unknown."""
    return F.coalesce(_lookup(normalize(c, makers), makers.countries), F.lit(""))


def country_name(code: Column, makers: Makers) -> Column:
    return _lookup(code, makers.country_names)


def _any(names: list[str]) -> str:
    return "|".join(re.escape(n).replace(r"\ ", " ") for n in names)


def _rank(found: Column, names: list[str]) -> Column:
    return _lookup(F.lower(found), {n.lower(): f"{i:06d}" for i, n in reversed(list(enumerate(names)))})


def parse_name(c: Column, makers: Makers) -> Column:
    """Struct (manufacturer, model) of a vehicle's full name.

    A spaced name as prefix wins; then, of the canonical names, the longest that is either the prefix
    or the second word after one token; else the first word, unless it's a number.
    """
    def find(t: Column) -> Column:
        cut = lambda used: F.regexp_replace(F.trim(F.substr(t, F.length(used) + 1)), r"^[\s\-/]+", "")
        pair = lambda a, b: F.struct(a.alias("manufacturer"), b.alias("model"))
        word = F.split_part(t, F.lit(" "), F.lit(1))
        rest = F.substr(t, F.length(word) + 2)
        plain = F.when(rest == "", pair(normalize(t, makers), F.lit(""))).when(word.rlike(r"^\d+$"), pair(F.lit(""), t)).otherwise(pair(normalize(word, makers), rest))
        out = F.when(t == "", pair(F.lit(""), F.lit("")))
        spaced, names = makers.spaced, makers.canonical
        if spaced:
            p = F.regexp_extract(t, f"(?iu)^({_any(spaced)})", 1)
            out = out.when(p != "", pair(normalize(_lookup(F.lower(p), {n.lower(): n for n in reversed(spaced)}), makers), cut(p)))
        if names:
            back = {n.lower(): n for n in reversed(names)}
            p = F.regexp_extract(t, f"(?iu)^({_any(names)})", 1)
            infix = rf"(?iuU)^([\d\w\-.]+)\s+({_any(names)})(?:\s+(.*))?$"
            i, head, tail = F.regexp_extract(t, infix, 2), F.regexp_extract(t, infix, 1), F.regexp_extract(t, infix, 3)
            first = (p != "") & ((i == "") | (_rank(p, names) <= _rank(i, names)))
            out = out.when(first, pair(normalize(_lookup(F.lower(p), back), makers), cut(p)))
            out = out.when(i != "", pair(normalize(_lookup(F.lower(i), back), makers), F.trim(F.concat_ws(" ", head, F.nullif(tail, F.lit(""))))))
        return out.otherwise(plain)

    return let(squeeze(F.coalesce(c, F.lit(""))), find)


def split_make(c: Column, makers: Makers) -> Column:
    """Struct (manufacturer, model) of a make field that may hold part of the model."""
    def find(t: Column) -> Column:
        pair = lambda a, b: F.struct(a.alias("manufacturer"), b.alias("model"))
        known = lambda x: normalize(x, makers).isin(*makers.countries) if makers.countries else F.lit(False)
        word = F.split_part(t, F.lit(" "), F.lit(1))
        out = F.when(t == "", pair(F.lit(""), F.lit(""))).when(known(t), pair(normalize(t, makers), F.lit("")))
        for n in makers.spaced:
            same = F.replace(F.lower(t), F.lit(" "), F.lit("-")) == n.lower().replace(" ", "-")
            out = out.when(F.startswith(F.lower(t), F.lit(n.lower())), pair(normalize(F.lit(n), makers), F.trim(F.substr(t, F.lit(len(n) + 1))))).when(same, pair(normalize(F.lit(n), makers), F.lit("")))
        return out.when(known(word), pair(normalize(word, makers), F.substr(t, F.length(word) + 2))).otherwise(pair(normalize(t, makers), F.lit("")))

    return let(squeeze(F.coalesce(c, F.lit(""))), find)
