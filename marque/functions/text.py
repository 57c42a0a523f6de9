"""Text clean-up of scraped names and cells, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.functions.columns import group, let, name
from marque.functions.exact import repair_mojibake, unescape_html

# Footnotes and markers, and the tails that test titles leave on model names (in this order).
NOISE = r"(?iu)\s*\[[^\]]*\]|\s*\([^)]*citation[^)]*\)|—?N/?[Aa]|\best\.?\b|\bclaim(?:ed)?\b"
#: All noise has one of these; looking for them costs far less than the pattern.
_MAY_BE_NOISE = r"[\[(aAeE]"
_END = r"\s*[\|–—-]?\s*$"
TEST_TAILS: tuple[str, ...] = (
    r"\s+long-?\s*term\s+road\s+test\s+wrap-?\s*up" + _END,
    r"\s+first\s+ride\s+reviews?" + _END,
    r"\s+first\s+drive\s+reviews?\s*\d*" + _END,
    r"\s+full\s+test\s+reviews?" + _END,
    r"\s+test\s+reviews?" + _END,
    r"\s+tested\s+reviews?" + _END,
    r"\s+test\s+a\s*reviews?" + _END,
    r"\s+instrumented\s+test" + _END,
    r"\s+first\s+drive" + _END,
    r"\s+first\s+ride" + _END,
    r"\s+prototype\s+ride" + _END,
    r"\s+prototype\s+drive" + _END,
    r"\s+full\s+test" + _END,
    r"\s+by\s+the\s+numbers" + _END,
    r"\s+long-?\s*term\s+(test\s+)?(wrap-?\s*(up)?|update|verdict).*$",
    r"\s+long-?\s*term\s+(test|update|verdict)" + _END,
    r"\s+road\s+test" + _END,
    r"\s+retest" + _END,
    *(rf"\s+{w}" + _END for w in ("test", "tested", "review", "reviews", "prototype", "instrumented", r"long\s+term")),
)
CUT_TAILS = tuple(rf"\s+{w}" + _END for w in (r"full\s+t", "ted", "t"))
ONLY_TAIL = r"(?i)^(?:first\s+drive|first\s+ride|prototype\s+ride|instrumented\s+test|test|review)\s*\|?\s*$"
REVIEW_TEXT = (r"(?i)\s+road\s+test\s+review\s+.*$", r"(?i)\s+first\s+drive\s+review\s+.*$", r"(?i)\s+review\s+[a-z].*$")
TESTED_TEXT = (r"(?i)\s+tested\s+(on|with|using|today).*$", r"(?i)\s+tested$")
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"(?i)\bPamera\b", "Panamera"),
    (r"(?i)\bLaferrari\b", "LaFerrari"),
    (r"(?i)\bLP\s*(\d+)\s+(\d+)\b", "LP$1-$2"),
    (r"(?i)\bLP\s+(\d+-\d+)\b", "LP$1"),
    (r"\b(\d+)Lt\b", "$1LT"),
    (r"\b(\d+)Gt\b", "$1GT"),
    (r"\b(?:Gt R|Gt-R|GT R|GTR)\b", "GT-R"),
    (r"\bGt Supercar\b", "GT Supercar"),
    (r"\b911\s+Gts\b", "911 GTS"),
    (r"\bGts\b", "GTS"),
    (r"\bNsx\b", "NSX"),
    (r"\bRs(\d+)\b", "RS$1"),
    (r"\bAmg\b", "AMG"),
    (r"\bPdk\b", "PDK"),
    (r"(?i)\bNismo\b", "NISMO"),
)


def _strip(c: Column, patterns: tuple[str, ...]) -> Column:
    """c without the patterns, one after the other, whatever their case."""
    return reduce(lambda x, p: F.regexp_replace(x, p if p.startswith("(?i") else "(?i)" + p, ""), patterns, c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Without footnotes, citations and markers; white space collapsed. Null becomes blank."""
    text = F.coalesce(c, F.lit(""))
    return squeeze(F.when(text.rlike(_MAY_BE_NOISE), F.regexp_replace(text, NOISE, "")).otherwise(text))


def year_of(c: Column) -> Column:
    """The first year from 1900 to 2099, as text."""
    return group(c, r"\b(19\d{2}|20\d{2})\b")


def spelled(model: Column) -> Column:
    """Usual spellings of model names."""
    return reduce(lambda x, r: F.regexp_replace(x, *r), SPELLINGS, model)


def repaired(df: DataFrame, *columns: str) -> DataFrame:
    """df with character references decoded and mojibake repaired in the columns; only rows that have them leave the JVM."""
    df = df.withColumns({c: unescape_html(name(c)) for c in columns if c in df.columns})
    return df.withColumns({c: repair_mojibake(name(c)) for c in columns if c in df.columns})


def model_key(model: Column, keep_parens: bool = False) -> Column:
    """Lower-case model without test tails, years and (unless kept) anything in parentheses: what merging compares."""
    m = F.trim(F.lower(F.coalesce(model, F.lit(""))))
    m = F.regexp_replace(F.regexp_replace(m, r"[;:]+\s*$", ""), r"\s+page\s+\d+\s*$", "")
    m = F.trim(F.regexp_replace(_strip(m, REVIEW_TEXT + TEST_TAILS), r"\s*\(\d{4}\)\s*", " "))
    if not keep_parens:
        m = F.trim(F.regexp_replace(m, r"\s*\([^)]+\)\s*", " "))
    return F.regexp_replace(m, r"\s+", " ")


def record_key(year: Column, manufacturer: Column, model: Column) -> Column:
    """What tells records apart: manufacturer and model (without anything in parentheses), and the year where there is one."""
    m = F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(model, F.lit("")))), r"\s*\([^)]+\)\s*", " "))
    maker = F.trim(F.lower(F.coalesce(manufacturer, F.lit(""))))
    return F.struct(F.nullif(year, F.lit("")).alias("year"), maker.alias("manufacturer"), F.regexp_replace(m, r"\s+", " ").alias("model"))


def stored_model(model: Column) -> Column:
    """A stored model name without test tails; case stays."""
    m = F.regexp_replace(F.coalesce(model, F.lit("")), r"[;:]+\s*$", "")
    m = _strip(F.regexp_replace(m, r"(?i)\s+page\s+\d+\s*$", ""), REVIEW_TEXT + TESTED_TEXT + TEST_TAILS)
    return spelled(F.trim(m))


def parsed_model(model: Column) -> Column:
    """A scraped model name, cleaned; blank where nothing but a test tail is there."""
    m = clean_text(model)
    m = F.regexp_replace(F.regexp_replace(m, r"\s*[\|–—-]\s*$", ""), r"[;:]+\s*$", "")
    m = _strip(m, TESTED_TEXT + TEST_TAILS + CUT_TAILS)
    m = F.regexp_replace(F.regexp_replace(m, ONLY_TAIL, ""), r"\s*[\|–—-]\s*$", "")
    return spelled(F.trim(m))


def title_case(c: Column) -> Column:
    """Each run of letters begins with a capital, the rest is lower: Python's str.title."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)")), F.initcap), "")


def without_prefix(model: Column, manufacturer: Column) -> Column:
    """model without a leading repetition of the manufacturer's whole name."""
    def cut(x: Column) -> Column:
        m, p = x["m"], F.concat(F.trim(x["p"]), F.lit(" "))
        hit = F.startswith(F.lower(F.trim(m)), F.lower(p)) & (p != " ")
        return F.when(hit, F.trim(F.substr(F.trim(m), F.length(p) + 1))).otherwise(m)

    return let(F.struct(model.alias("m"), manufacturer.alias("p")), cut)


def car_id(year: Column, manufacturer: Column, model: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the three, lower-case letters and digits only."""
    parts = [F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]", "") for c in (year, manufacturer, model)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def label(year: Column, manufacturer: Column, model: Column) -> Column:
    """What a person calls the row."""
    parts = [F.nullif(c.cast("string"), F.lit("")) for c in (year, manufacturer, model)]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("Unknown car"))
