"""Main text of web pages by line-block distribution.

The page is stripped of markup into lines, one for each block element. A line weighs its
characters: none inside menus, headers, footers, asides, forms, adverts, notices or
reader comments, and without those of links where the page names no main region. The
weights are summed over sliding windows of lines; text is kept from a surge (the sum passes
a threshold) to the next dive (the sum is zero). In a page with an ``article`` or ``main``
element only lines inside count, and any weight there is a surge.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.arrow import map_slices

#: Lines of a window, and the characters in it that start a text where no main region is named.
WINDOW = 3
SURGE = 80

# Fixed values of HTML and of common page markup.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video head noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AWAY = frozenset("nav footer aside form button select dialog menu".split())
_REGION = frozenset(("article", "main"))
_HINTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations comment comments commentlist discussion disqus respond replies footer masthead toolbar login search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|\d+")


def _hidden(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no main text. A header inside the main region is part of it."""
    if name in _AWAY or name == "header" and not inside:
        return True
    if "=" not in attrs or name in ("html", "body", "article", "main"):
        return name == "article" and "comment" in attrs.lower()
    for k, *v in _ATTR.findall(attrs):
        k, text = k.lower(), "".join(v).lower()
        if k == "role" and text in _ROLES:
            return True
        if k in ("class", "id") and any(not _HINTS.isdisjoint(_WORD.findall(x)) for x in text.split()):
            return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, weight outside links, inside a main region) of each line; whether there is a main region."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # name, hides
    buf: list[str] = []
    hides = region = links = linked = 0
    named = False
    at = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buf)).split())
        if text:
            out.append((text, max(0, len(text) - linked), region > 0))
        buf.clear()
        linked = 0

    def pop(upto: int) -> None:
        nonlocal hides, region, links
        while len(stack) > upto:
            name, h = stack.pop()
            hides -= h
            region -= name in _REGION
            links -= name == "a"

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not hides:
            buf.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name in _BLOCKS and name != "hr":
            end()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in _REGION and name not in ("body", "html", *_REGION):
                    break  # a stray end tag closes nothing outside the region
            continue
        if name == "br" or name == "hr":
            end() if name == "hr" else buf.append(" ")
            continue
        if name in _VOID or attrs.endswith("/") and name in _RAW:
            continue
        if name in _RAW and name != "head":
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            buf.append(" ")
            continue
        if name == "body":
            pop(0)
        elif name in _REGION and not _hidden(name, attrs, True):
            if hides:  # what was left open before the main text
                pop(next(i for i, s in enumerate(stack) if s[1]))
            named = True
        elif name == "p" and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        h = name == "head" or _hidden(name, attrs, region > 0)
        if h:
            end()
        stack.append((name, h))
        hides += h
        region += name in _REGION
        links += name == "a"
    end()
    return out, named


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, joined by two newlines. Empty for null or empty pages."""
    if not page:
        return ""
    found, named = lines(page)
    if named and any(x[2] for x in found):
        weight, surge = [len(t) if inside else 0 for t, _, inside in found], 0
    else:
        weight, surge = [w for _, w, _ in found], SURGE
    n = len(found)
    total = [sum(weight[i : i + WINDOW]) for i in range(n)]
    if found and surge and max(total) <= surge:
        surge = max(total) - 1  # a page with little text: its densest window
    keep: list[str] = []
    i = 0
    while i < n:
        if total[i] <= surge or not weight[i]:
            i += 1
            continue
        stop = i
        while stop < n and total[stop] > 0:
            stop += 1
        keep += [found[k][0] for k in range(i, stop) if weight[k] or not named]
        i = stop
    return "\n\n".join(keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every page; no shuffle.

    Null and empty pages give an empty text; repeated rows give repeated results; other
    columns are not read. Whole pages are parsed, whatever their length.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(x) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    t, u = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_slices(rows, run, f"id {t}, url {u}, text string, n_chars long", by=2).withColumnsRenamed({"id": id_col, "url": url_col})
