from __future__ import annotations

import re

import pytest

from pyspark.sql import functions as F

from marque.llm import pii
from marque.llm.pii import kind_of, pseudonymise, surrogate


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def of(spark, values, key="k"):
    df = spark.createDataFrame([(v,) for v in values], "e string")
    return {r.e: (r.k, r.s) for r in df.select("e", kind_of(F.col("e")).alias("k"), surrogate(F.col("e"), key).alias("s")).collect()}


def test_types_and_formats(spark):
    got = of(spark, ["ann.Lee+7@mail3.example.com", "x_1@foo.co.uk", "8.8.4.4", "10.1.2.3", "192.168.7.9", "+1 (555) 123-4567", "(555) 123-4567", "123-45-6789", "4539 1488 0343 6467", "4539148803436467", "9566113270", "0641917ea4e9feb9cda83477b57ac2654884f485", "Tok_9aBcDeFgHiJkLmNo", "Mrs. Smith", "Mr John Smith", "г-жа Иванова"])
    shape = lambda s: re.sub("[0-9]", "0", s)
    for e, (k, s) in got.items():
        assert s and s != e, e
        if k in ("number", "card"):
            assert shape(s) == shape(e)
    assert got["+1 (555) 123-4567"][1].startswith("+1 (")
    assert got["ann.Lee+7@mail3.example.com"][1].endswith(".example.com") and got["x_1@foo.co.uk"][1].endswith(".uk")
    assert re.fullmatch(r"[a-z]{3}\.[A-Z][a-z]{2}\+\d@[a-z]{4}\d\.example\.com", got["ann.Lee+7@mail3.example.com"][1])
    assert got["4539 1488 0343 6467"][0] == "card" and luhn(got["4539 1488 0343 6467"][1])
    assert got["4539 1488 0343 6467"][1].replace(" ", "") == got["4539148803436467"][1] and got["4539148803436467"][1][0] == "4"
    assert got["10.1.2.3"][1].startswith("10.1.") and got["192.168.7.9"][1].startswith("192.168.") and not got["8.8.4.4"][1].startswith(("10.", "127.", "192.168."))
    assert re.fullmatch("[0-9a-f]{40}", got["0641917ea4e9feb9cda83477b57ac2654884f485"][1])
    assert re.fullmatch(r"[A-Z][a-z]{2}_\d[A-Za-z]{15}", got["Tok_9aBcDeFgHiJkLmNo"][1])
    assert re.fullmatch(r"Mrs\. [A-Z]\w+", got["Mrs. Smith"][1]) and got["Mr John Smith"][1].split()[1] in pii._NAMES["latin", "m"]
    assert re.fullmatch(r"г-жа [А-Я][а-яё]+", got["г-жа Иванова"][1])


def test_number_and_address_permutations_keep_apart(spark):
    n = spark.range(4000).select(F.concat(F.lit("55"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("d"), F.concat_ws(".", F.lit("20"), F.floor(F.col("id") / 256).cast("string"), (F.col("id") % 256).cast("string"), F.lit("9")).alias("a"))
    r = n.select(F.count_distinct(pii._plain_number("k", F.col("d"))), F.count_distinct(pii._address("k", F.col("a")))).first()
    assert tuple(r) == (4000, 4000)


def test_text_is_kept_around_and_coreference_holds(spark):
    mail, ip = "bob@mail.example.com", "8.8.8.8"
    rows = [(1, f"Write {mail} or {mail}, host {ip}.", "x"), (2, f"{mail}", "y"), (3, None, None), (4, "", ""), (5, "No data here; version 2.0, 12 and 2024.", "z"), (5, "No data here; version 2.0, 12 and 2024.", "z"), (6, f"{ip}\n{ip} end " + "w " * 5000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, es string")
    out = {r.doc_id: r for r in pseudonymise(df, "k").collect()}
    m = out[2].text
    assert m != mail and out[1].text.startswith(f"Write {m} or {m}, host ") and out[1].text.endswith(".")
    i = out[1].text.split("host ")[1][:-1]
    assert out[6].text == f"{i}\n{i} end " + "w " * 5000 and out[6].n_entities == 2 and out[1].n_entities == 3
    assert out[3].text is None and out[4].text == "" and out[5].text == rows[4][1] and out[1].es == "x"
    assert pseudonymise(df, "other").where("doc_id = 2").first().text != m
    assert pseudonymise(df.where("false"), "k").count() == 0


def test_colliding_surrogates_are_redrawn(spark):
    names = [f"{a}{b}" for a in ("Ba", "Ce", "Di", "Fo", "Gu", "Ha", "Ke", "Li", "Mo", "Nu", "Pa", "Re", "Si", "To", "Vu") for b in ("ck", "dd", "ff", "gg", "ll", "mm", "nn", "pp", "rr", "ss", "tt", "zz", "lk", "rn", "st", "nd", "mb", "ft", "rk", "lm")]
    df = spark.createDataFrame([(i, f"Mr {n} met Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    out = [r.text for r in pseudonymise(df, "k").collect()]
    first = [t.split(" met ")[0] for t in out]
    assert all(t == f"{a} met {a}" for t, a in zip(out, first, strict=True))
    assert len(set(first)) == len(names) and not {*first} & {f"Mr {n}" for n in names}


def test_more_surnames_of_one_title_than_short_surrogates(spark):
    """20 x 16 stems and ends, and 20 x 20 x 16 with one more syllable, are fewer than these."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr B"), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "abcdefghij")).alias("text"))
    out = pseudonymise(df, "k").cache()
    assert out.select("text").distinct().count() == 9000
    assert out.join(df.select("text"), "text").count() == 0


def test_a_number_never_becomes_another_of_the_corpus(spark):
    a, n = "20.30.40.50", "9566113270"
    first = of(spark, [a, n])
    values = [a, n, first[a][1], first[n][1]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    got = {r.text for r in pseudonymise(df, "k").collect()}
    assert len(got) == 4 and not got & set(values)


def test_without_a_free_surrogate_it_fails(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_DRAWS", 1)
    monkeypatch.setattr(pii, "ROOM", 0)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr B"), F.translate(F.lpad(F.col("id").cast("string"), 3, "0"), "0123456789", "abcdefghij")).alias("text"))
    with pytest.raises(ValueError):
        pseudonymise(df, "k")


def test_long_runs_of_digits_are_replaced_in_every_piece(spark):
    values = ["".join(str((i * i + n) % 10) for i in range(n)) for n in (31, 56, 57, 58, 84, 85, 200)] + ["12345678-" * 5]
    got = of(spark, values)
    for e, (k, s) in got.items():
        assert k == "number" and len(s) == len(e) and re.sub(r"\d", "0", s) == re.sub(r"\d", "0", e), e
        assert all(s[i : i + 28] != e[i : i + 28] for i in range(0, len(e) - 4, 28)), e
    near = of(spark, ["7" * 40 + f"{i:03}" for i in range(300)])
    assert len({s for _, s in near.values()}) == 300


def test_dense_addresses_and_numbers_stay_apart(spark):
    """All of 10.0.0.0/18, and a tenth of all nine-digit numbers' last five places."""
    i = F.col("id")
    df = spark.range(16384).select(i.alias("doc_id"), F.concat_ws(".", F.lit("10.0"), F.floor(i / 256).cast("string"), (i % 256).cast("string")).alias("text"))
    out = pseudonymise(df, "k").cache()
    assert out.select("text").distinct().count() == 16384 and out.join(df, ["doc_id", "text"]).count() == 0
    assert out.where(~F.col("text").startswith("10.0.")).count() == 0
    df = spark.range(20000).select(i.alias("doc_id"), F.concat(F.lit("5550"), F.lpad(i.cast("string"), 5, "0")).alias("text"))
    out = pseudonymise(df, "k").cache()
    assert out.select("text").distinct().count() == 20000 and out.join(df.select("text"), "text").count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_permutations_are_whole_and_leave_nothing_as_it_is(spark, n):
    d = F.lpad(F.col("id").cast("string"), n, "0")
    r = spark.range(10**n).select(d.alias("d"), pii._permuted("k", d, F.lit("x")).alias("p"))
    assert r.select("p").distinct().count() == 10**n and r.where("d = p or length(p) <> length(d)").count() == 0


def test_private_addresses_are_those_that_keep_two_octets(spark):
    rows = [(f"{a}.{b}.7.9",) for a in range(0, 256) for b in (0, 1, 15, 16, 31, 32, 168, 254)]
    df = spark.createDataFrame(rows, "e string").select("e", pii._private(F.col("e")).alias("p"), pii._address("k", F.col("e")).alias("s"))
    for r in df.collect():
        same = r.e.split(".")[:2] == r.s.split(".")[:2]
        assert same if r.p else not (pii_private := re.match(r"^(?:0|10|127|2(?:2[4-9]|[345]\d))\.", r.s)), (r.e, pii_private)


def test_family_names_and_layouts_refer_alike(spark):
    """A family name has one surrogate with any title or given name, redrawn or not; a number in any layout."""
    fam = ["B" + "".join("abcdefghij"[int(c)] for c in f"{i:03}") for i in range(900)]
    rows = [(i, f"Mr Karl {f}; Mr {f}; Mrs Anna {f}; Mr. {f}; 555-{i:03}-4567 and 555{i:03}4567") for i, f in enumerate(fam)]
    out = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    seen = set()
    for r in out:
        a, b, c, d, rest = r.text.split("; ")
        assert a.split()[2] == b.split()[1] == c.split()[2] == d.split()[1]
        assert (a.split()[0], b.split()[0], c.split()[0], d.split()[0]) == ("Mr", "Mr", "Mrs", "Mr.")
        x, y = rest.split(" and ")
        assert x.replace("-", "") == y and y != rows[r.doc_id][1].split()[-1]
        seen |= {a, b, c, d, x, y}
    assert len(seen) == 6 * 900 and not seen & {e for _, t in rows for e in re.split("; | and ", t)}
    assert len({t.split()[1] for t in seen if t.startswith("Mr ") and len(t.split()) == 3}) == 1


def test_whole_query_equals_entity_by_entity(spark):
    """Every entity that the pattern finds is replaced alike everywhere, and all between stays, against Python's own split."""
    import regex

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(200).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen: dict[str, str] = {}
    for r in pseudonymise(df, "k").collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.text is None
            continue
        found = [m.group() for m in regex.finditer(pii.PATTERN, t)]
        gaps = [re.escape(t[a:b]) for a, b in zip([0, *[m.end() for m in regex.finditer(pii.PATTERN, t)]], [*[m.start() for m in regex.finditer(pii.PATTERN, t)], len(t)], strict=True)]
        m = re.fullmatch("(.+?)".join(gaps), r.text, re.S) if found else None
        assert r.n_entities == len(found) and (m or r.text == t)
        for e, s in zip(found, m.groups() if m else (), strict=True):
            assert seen.setdefault(e, s) == s and s != e
    assert len(set(seen.values())) == len(seen) and seen
