"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, phone and other long numbers, payment cards,
secrets (long mixed tokens) and titled names. A surrogate depends on a secret key and on the
entity alone, so an entity is replaced alike wherever it occurs. It keeps the type and
format: digits stay digits in the same layout, cards keep their first digit and a valid check
digit, public addresses stay public, hexadecimal stays hexadecimal, names keep title, gender,
script and number of words, and the case of letters is kept.

Numbers, cards and addresses go through a keyed permutation (a Feistel network about a shift, which
leaves no number as it is), so that no two become equal, however dense they are. Numbers are alike
in any layout. Names are drawn by part: a family name has one surrogate wherever it stands,
with or without a given name. All is checked over the whole corpus: where two values share a
surrogate, or a surrogate is itself a value of the corpus, the later ones are drawn anew (names
and local parts longer and longer) until all differ; where that can't be reached an error is
raised. A surrogate may be another's value only where it must: of numbers of a length of which
more than one in DENSE occurs, and of private addresses, which keep their first two octets. Only
those redrawn travel back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marque.llm.shared import cut

#: Redraws after which a name or local part gets longer (by one more each time), and after which the search fails.
LONGER_AFTER, MAX_DRAWS = 1, 40
#: Numbers of a length are dense when one in so many occurs.
DENSE = 10
#: Names to draw from for each one of the corpus.
ROOM = 30
#: Estimated bytes up to which the redrawn entities of documents are broadcast.
BROADCAST_BYTES = 16_000_000

# Titles by gender, and names by script and gender to draw from.
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "г-н")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "г-жа")
_NAMES = {
    ("latin", "m"): ("Adrian", "Bruno", "Colin", "David", "Edgar", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Tobias", "Viktor"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sonja", "Teresa", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Сергей", "Тимур", "Фёдор", "Юрий"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"),
}
_STEMS = {"latin": ("Al", "Bern", "Carl", "Dorn", "Eng", "Fal", "Gar", "Hart", "Is", "Jan", "Kell", "Lund", "Mar", "Nor", "Os", "Pell", "Rav", "Sand", "Tor", "Wern"), "cyrillic": ("Бел", "Вол", "Гор", "Дуб", "Ель", "Зор", "Кал", "Лун", "Мор", "Нев", "Орл", "Пол", "Рав", "Сол", "Тих", "Яс")}
_ENDS = {"latin": ("berg", "dal", "en", "ford", "hof", "ing", "ley", "man", "ner", "son", "ström", "ton", "wald", "well", "wick", "worth"), "cyrillic": ("енко", "ин", "кович", "ник", "ский", "ук", "ченко", "юк")}

_TITLE = "(?:" + "|".join(_MALE + _FEMALE) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<!\d)\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\d-])\d{3}[-. ]\d{2,3}[-. ]\d{4}(?![\d-])",
    r"(?<![\dA-Za-z.])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])",
    r"(?<![\dA-Za-z.])\d{9,12}(?![\dA-Za-z])",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+\d)[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])",
    rf"(?<!\p{{L}}){_TITLE} \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
)
PATTERN = "|".join(_PATTERNS)
#: A text without these has no entity.
_MAYBE = r"[0-9@]|(?:" + "|".join(_MALE + _FEMALE) + ")"


def _let(value: Column, body) -> Column:
    """body(value), the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column, start: int = 1, size: int = 12) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("long")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted(key: str, digits: Column, salt: Column) -> Column:
    """A keyed permutation, without a fixed point, of the digit strings of each length from 2; shorter ones stay, longer ones than 30 go in pieces.

    Four turns, each adding a hash of one half to the other; a fifth that adds no zero; and the four undone.
    """
    turns = [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (3, -1), (2, -1), (1, -1), (0, -1)]

    def run(d: Column) -> Column:
        n = F.length(d)
        ln = F.floor(n / 2).cast("int")
        rn = n - ln
        start = F.struct(F.substr(d, F.lit(1), ln).alias("l"), F.substr(d, ln + 1, rn).alias("r"))

        def turn(acc: Column, t: Column) -> Column:
            def added(x: Column, size: Column, by: Column) -> Column:
                h = _number(_hash(key, salt, t["k"], size, by))
                h = F.when(t["k"] == 4, F.pmod(h, _ten(size) - 1) + 1).otherwise(F.pmod(h, _ten(size)))
                return F.lpad(F.pmod(x.cast("long") + t["sign"] * h, _ten(size)).cast("string"), size, F.lit("0"))

            left = F.struct(added(acc["l"], ln, acc["r"]).alias("l"), acc["r"].alias("r"))
            right = F.struct(acc["l"].alias("l"), added(acc["r"], rn, acc["l"]).alias("r"))
            return F.when(t["k"] % 2 == 0, left).otherwise(right)

        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(sign).alias("sign")) for k, sign in turns])
        return F.aggregate(steps, start, turn, lambda a: F.concat(a["l"], a["r"]))

    def pieces(d: Column) -> Column:
        n = F.ceil(F.length(d) / 28).cast("int")  # a last piece of one digit joins the one before: 29 at most
        ends = lambda i: F.when(F.length(d) - (i + 1) * 28 < 2, F.length(d)).otherwise((i + 1) * 28)
        piece = lambda i: _let(F.substr(d, i * 28 + 1, ends(i) - i * 28), lambda x: F.when(F.length(x) > 1, run(x)).otherwise(""))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), piece), "")

    return F.when(F.length(digits).between(2, 30), _let(digits, run)).when(F.length(digits) > 30, _let(digits, pieces)).otherwise(digits)


def _laid_out(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced by those given, in order."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(acc["rest"], F.lit(1), F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, F.substr(acc["rest"], F.lit(2))).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(F.filter(F.split(layout, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), digits.alias("rest")), put, lambda a: a["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _salt(name: str, nonce: Column) -> Column:
    return F.when(nonce == 0, F.lit(name)).otherwise(F.concat(F.lit(name), nonce.cast("string")))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum of a digit string; doubled: 1 if the last digit counts double, else 0."""
    ds = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((i + doubled) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(ds, weigh), F.lit(0), lambda a, d: a + d)


def _card_digits(key: str, d: Column, nonce: Column) -> Column:
    """The first digit stays, and the check digit is made anew."""
    inner = _permuted(key, F.substr(d, F.lit(2), F.length(d) - 2), _salt("card", nonce))
    return _let(F.concat(F.substring(d, 1, 1), inner), lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 1), F.lit(10)).cast("string")))


def _card(key: str, e: Column, nonce: Column) -> Column:
    return _laid_out(e, _let(_digits(e), lambda d: _card_digits(key, d, nonce)))


def _head(e: Column) -> Column:
    """The country code of a number, which stays."""
    return F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)


def _tail(e: Column) -> Column:
    return F.substr(e, F.length(_head(e)) + 1)


def _plain_number(key: str, e: Column, nonce: Column | None = None) -> Column:
    salt = F.lit("number") if nonce is None else _salt("number", nonce)
    return _let(_tail(e), lambda tail: F.concat(_head(e), _laid_out(tail, _permuted(key, _digits(tail), salt))))


def _private(e: Column) -> Column:
    """Whether an address keeps its first two octets."""
    return e.rlike(r"^(?:0|10|127|2(?:2[4-9]|[345]\d)|172\.(?:1[6-9]|2\d|3[01])|192\.168|169\.254)\.")


def _address(key: str, e: Column, nonce: Column | None = None) -> Column:
    salt = F.lit if nonce is None else lambda name: _salt(name, nonce)

    def public(hi: Column, lo: Column) -> Column:
        a = F.shiftright(hi, 8)
        return ~(a.isin(0, 10, 127) | (a >= 224) | hi.between(172 * 256 + 16, 172 * 256 + 31) | hi.isin(192 * 256 + 168, 169 * 256 + 254))

    def turn(acc: Column, k: Column) -> Column:
        mask = lambda by, side: F.pmod(_number(_hash(key, salt("ip"), k, F.lit(side), by)), F.lit(65536)).cast("int")
        return _let(acc["hi"].bitwiseXOR(mask(acc["lo"], "h")), lambda h: F.struct(h.alias("hi"), acc["lo"].bitwiseXOR(mask(h, "l")).alias("lo")))

    def walked(s: Column) -> Column:
        """Whole cycles of four turns until the address is public: that keeps the permutation one."""
        once = lambda x: F.aggregate(F.array(*[F.lit(k) for k in range(4)]), x, turn)
        step = lambda acc, _: F.when(public(acc["hi"], acc["lo"]), acc).otherwise(once(acc))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), once(s), step)

    def run(o: Column) -> Column:
        at = lambda i: F.element_at(o, i).cast("int")
        start = F.struct((at(1) * 256 + at(2)).alias("hi"), (at(3) * 256 + at(4)).alias("lo"))
        text = lambda hi, lo: F.concat_ws(".", F.shiftright(hi, 8).cast("string"), (hi % 256).cast("string"), F.shiftright(lo, 8).cast("string"), (lo % 256).cast("string"))

        def whole(s: Column) -> Column:
            h = _hash(key, salt("private"), s["hi"])
            inner = F.pmod(s["lo"] * (2 * _number(h, 1, 4) + 1) + 2 * _number(h, 5, 4) + 1, F.lit(65536)).cast("int")  # both odd: no fixed point
            return F.when(public(s["hi"], s["lo"]), _let(walked(s), lambda w: text(w["hi"], w["lo"]))).otherwise(text(s["hi"], inner))

        return _let(start, whole)

    return _let(F.split(e, r"\."), run)


def _letters(text: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """text with each letter and digit drawn anew in its own class by the bytes of digest."""

    def draw(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7
        pick = lambda low, n: F.char((F.lit(low) + F.pmod(F.ascii(c) - low + v, F.lit(n))).cast("long"))
        out = F.when(c.between("0", "9"), pick(48, 10)).when(c.between("a", "z"), pick(97, 26)).when(c.between("A", "Z"), pick(65, 26)).otherwise(c)
        if hexadecimal is None:
            return out
        return F.when(hexadecimal & c.between("a", "f"), pick(97, 6)).when(hexadecimal & c.between("A", "F"), pick(65, 6)).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), draw), "")


def _email(key: str, e: Column, nonce: Column) -> Column:
    """Local part by the whole address, domain by itself (one domain stays one domain); the last label stays."""
    local, domain = F.regexp_extract(e, "^(.*)@", 1), F.lower(F.regexp_extract(e, "@(.*)$", 1))
    labels = F.split(domain, r"\.")
    tail = F.when(domain.rlike(r"(^|\.)example\.[a-z]+$"), 2).otherwise(1)
    keep = F.slice(labels, F.greatest(F.size(labels) - tail + 1, F.lit(1)), F.lit(2))
    moved = F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - tail, F.lit(0))), lambda x: _letters(x, _hash(key, F.lit("domain"), domain)))
    digest = _hash(key, F.lit("local"), F.lower(e), nonce)
    longer = F.concat(local, F.repeat(F.lit("x"), F.greatest(nonce - LONGER_AFTER, F.lit(0))))
    return F.concat(_letters(longer, digest), F.lit("@"), F.array_join(F.concat(moved, keep), "."))


def _secret(key: str, e: Column, nonce: Column) -> Column:
    return _letters(e, _hash(key, F.lit("secret"), e, nonce), e.rlike("^[0-9a-fA-F]+$"))


def _parts(e: Column) -> Column:
    """Struct of a titled name: title, script, gender, given (null without one), family."""
    title = F.regexp_extract(e, rf"^({_TITLE}) ", 1)
    rest = F.split(F.substr(e, F.length(title) + 2), " ")
    gender = F.when(F.regexp_replace(title, r"\.$", "").isin(*_MALE), "m").otherwise("f")
    script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.struct(title.alias("title"), script.alias("script"), gender.alias("gender"), F.when(F.size(rest) > 1, F.element_at(rest, 1)).alias("given"), F.element_at(rest, -1).alias("family"))


def _part(key: str, kind: Column, value: Column, nonce: Column, longer: int = 0) -> Column:
    """The surrogate of a part of a name: kind is its script, and the gender for a given name."""
    digest = _hash(key, kind, value, nonce)

    def of(values: tuple[str, ...], d: Column, at: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(_number(d, at, 8), F.lit(len(values))) + 1).cast("int"))

    def more(script: str) -> Column:
        each = F.array_repeat(digest, longer + F.greatest(nonce - LONGER_AFTER, F.lit(0)))
        syllable = lambda d, i: F.lower(of(_STEMS[script], F.sha2(F.concat_ws("\x1f", d, i.cast("string")), 256), 1))
        return F.array_join(F.transform(each, syllable), "")

    out = None
    for script in ("latin", "cyrillic"):
        rules = [(script, F.concat(of(_STEMS[script], digest, 1), more(script), of(_ENDS[script], digest, 17)))]
        rules += [(script + g, F.concat(of(_NAMES[script, g], digest, 1), more(script))) for g in ("m", "f")]
        for k, v in rules:
            out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def _name(key: str, e: Column, longer: tuple[int, int] = (0, 0)) -> Column:
    def run(p: Column) -> Column:
        given = _part(key, F.concat(p["script"], p["gender"]), p["given"], F.lit(0), longer[1])
        return F.concat_ws(" ", p["title"], F.when(p["given"].isNotNull(), given), _part(key, p["script"], p["family"], F.lit(0), longer[0]))

    return _let(_parts(e), run)


def kind_of(e: Column) -> Column:
    d = _digits(e)
    numeric = ~e.rlike(r"\p{L}")
    return F.when(F.contains(e, F.lit("@")), "email").when(e.rlike(rf"^{_TITLE} "), "name").when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "address").when(numeric & ~e.startswith("+") & F.length(d).between(13, 19) & (F.pmod(_luhn_sum(d, 0), F.lit(10)) == 0), "card").when(numeric & ~e.contains("_"), "number").otherwise("secret")


def surrogate(e: Column, key: str, nonce: Column | None = None, longer: tuple[int, int] = (0, 0)) -> Column:
    """The replacement of an entity; longer: further syllables of family and given names. The nonce counts for what isn't a name."""
    n = F.lit(0) if nonce is None else nonce
    kinds = lambda k: F.when(k == "email", _email(key, e, n)).when(k == "name", _name(key, e, longer)).when(k == "address", _address(key, e, n)).when(k == "card", _card(key, e, n)).when(k == "number", _plain_number(key, e, n)).otherwise(_secret(key, e, n))
    return _let(kind_of(e), kinds)


def _settled(values: DataFrame, draw, checked: Column) -> DataFrame:
    """values(kind, e), distinct -> (kind, e, s) of those redrawn: until no two of a kind share a surrogate and none is its own.

    draw(kind, e, nonce) is a surrogate; checked: the kinds whose surrogates must be no value of the corpus either.
    """
    known = cut(values.select("kind", "e", draw(F.col("kind"), F.col("e"), F.lit(0)).alias("s"), F.lit(0).alias("nonce")))
    for _ in range(MAX_DRAWS):
        first = known.groupBy("kind", "s").agg(F.min(F.struct("nonce", "e")).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "s", F.col("first.e").alias("keep"))
        late = known.join(first, ["kind", "s"]).where("e <> keep").select("kind", "e")
        own = known.where("e = s").select("kind", "e")
        real = known.where(checked).select("kind", F.col("s").alias("e"), F.col("e").alias("of")).join(known.select("kind", "e"), ["kind", "e"]).select("kind", F.col("of").alias("e"))
        again = cut(late.unionByName(own).unionByName(real).distinct())
        if again.isEmpty():
            return known.where("nonce > 0").select("kind", "e", "s")
        nonce = F.col("nonce") + 1
        fresh = known.join(again, ["kind", "e"]).select("kind", "e", draw(F.col("kind"), F.col("e"), nonce).alias("s"), nonce.alias("nonce"))
        known = cut(known.join(again, ["kind", "e"], "left_anti").unionByName(fresh))
    raise ValueError(f"after {MAX_DRAWS} redraws some entities still share a surrogate, or have a value of the corpus")


def _room(n: int, space: int, syllables: int) -> int:
    """Further syllables so that there are ROOM names for each of n."""
    out = 0
    while n and space * syllables**out < ROOM * n:
        out += 1
    return out


def _redrawn(entities: DataFrame, key: str) -> tuple[DataFrame, tuple[int, int]]:
    """entities(e), distinct -> (e, s) of those redrawn, and how much longer names are for so many."""
    kinds = cut(entities.select("e", kind_of(F.col("e")).alias("kind")))
    rest = kinds.where("kind in ('email', 'address', 'secret')").select("kind", "e")
    plain = _settled(rest, lambda _, e, n: surrogate(e, key, n), (F.col("kind") != "address") | ~_private(F.col("e"))).select("e", "s")

    laid = cut(kinds.where("kind in ('number', 'card')").select("kind", "e", _digits(_tail(F.col("e"))).alias("d")))
    digits = cut(laid.select("kind", F.col("d").alias("e")).distinct())
    lengths = digits.where("kind = 'number' and length(e) <= 15").groupBy(F.length("e").alias("n")).count().collect()  # 15 rows at most
    dense = [r.n for r in lengths if DENSE * r["count"] >= 10**r.n]
    drawn = lambda kind, d, n: F.when(kind == "card", _card_digits(key, d, n)).otherwise(_permuted(key, d, _salt("number", n)))
    moved = _settled(digits, drawn, (F.col("kind") == "card") | ~F.length("e").isin(dense or [0])).withColumnRenamed("e", "d")
    plain = plain.unionByName(laid.join(moved, ["kind", "d"]).select("e", F.concat(_head(F.col("e")), _laid_out(_tail(F.col("e")), F.col("s"))).alias("s")))

    names = cut(kinds.where("kind = 'name'").select("e", _parts(F.col("e")).alias("p")).select("e", "p.*", F.concat("p.script", "p.gender").alias("sex")))
    family = F.struct(F.col("script").alias("kind"), F.col("family").alias("e"))
    given = F.struct(F.col("sex").alias("kind"), F.col("given").alias("e"))
    parts = cut(names.select(F.explode(F.array(family, given)).alias("p")).select("p.*").where("e is not null").distinct())
    n = {r.kind: r.n for r in parts.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # six kinds at most
    longer = (max([_room(n[k], 128, 16) for k in n if k in _STEMS], default=0), max([_room(n[k], 16, 16) for k in n if k not in _STEMS], default=0))
    is_family = F.col("kind").isin(*_STEMS)
    pick = lambda kind, e, nonce: F.when(kind.isin(*_STEMS), _part(key, kind, e, nonce, longer[0])).otherwise(_part(key, kind, e, nonce, longer[1]))
    new = cut(_settled(parts, pick, is_family))
    by = lambda kind, value, s: new.select(F.col("kind").alias(kind), F.col("e").alias(value), F.col("s").alias(s))
    both = names.join(by("script", "family", "fs"), ["script", "family"], "left").join(by("sex", "given", "gs"), ["sex", "given"], "left").where("fs is not null or gs is not null")
    first = F.when(F.col("given").isNotNull(), F.coalesce("gs", _part(key, F.col("sex"), F.col("given"), F.lit(0), longer[1])))
    last = F.coalesce("fs", _part(key, F.col("script"), F.col("family"), F.lit(0), longer[0]))
    return plain.unionByName(both.select("e", F.concat_ws(" ", "title", first, last).alias("s"))), longer


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with the entities of the text replaced, and their number added.

    A null text stays null with 0 entities; an empty one stays empty. Other columns pass through, whatever
    their names (one named count_col is replaced); repeated rows are treated alike. The
    same key gives the same surrogates for the same corpus.
    """
    cols = [c for c in docs.columns if c != count_col]
    text = F.col(text_col)
    found = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    lists = docs.select(F.xxhash64(text_col).alias("key"), found.alias("es")).where(F.size("es") > 0)
    once = cut(lists.select("key", F.explode(F.array_distinct("es")).alias("e")).distinct())
    fix, longer = _redrawn(once.select("e").distinct(), key)
    by_text = cut(once.join(fix, "e").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("e", "s"))).alias("fix")))
    n = by_text.count()
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), text.alias("text"), F.xxhash64(text_col).alias("key"), F.coalesce(found, F.array().cast("array<string>")).alias("es"))
    base = base.join(F.broadcast(by_text) if n * 400 <= BROADCAST_BYTES else by_text, "key", "left")
    new = F.transform("es", lambda e: F.coalesce(F.element_at("fix", e), surrogate(e, key, longer=longer)))
    gaps = F.split("text", PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    out = F.when(F.size("es") > 0, whole).otherwise(F.col("text"))
    kept = [out.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in cols]
    return base.select(*kept, F.size("es").cast("long").alias(count_col))
