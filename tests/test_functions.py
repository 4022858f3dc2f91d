"""Column functions against slow specifications, and the registered queries against DuckDB on small fixtures."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docspark.functions import numbers
from docspark.functions import text as X
from docspark.operators import runs, tables
from docspark.operators.names import file_names, folded, json_keys
from docspark.sources.text import value_text

ALPHABET = ["a", "B", "1", "9", " ", "\t", "\n", "\r", "&", "#", ";", "<", ">", "|", "\\", "*", "_", "`", "[", "]", "(", ")", '"', ".", "-", "+", ":", "/", "?", "é", " ", " ", "日", "\U0001f600", "%"]


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(11)
    texts = ["", " ", "&amp;", "&#x41;", "& b", "1. a", "12) b", "- c", "-d", "# e", "7"] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()


def both(samples, column):
    texts, df = samples
    got = {r.i: r.v for r in df.select("i", column.alias("v")).collect()}
    return [(t, got[i]) for i, t in enumerate(texts)]


def spec_escape(t):
    out = ""
    for i, c in enumerate(t):
        rest = t[i + 1 :].removeprefix("#")
        name = ""
        for d in rest:
            if not (d.isascii() and d.isalnum()):
                break
            name += d
        if c == "&" and name and rest[len(name) : len(name) + 1] == ";":
            out += "&amp;"
        else:
            out += {"<": "&lt;"}.get(c, "\\" + c if c in "\\*_`[]" else c)
    return out


def spec_url(t):
    return "".join("&amp;" if c == "&" else "".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or unicodedata.category(c) == "Cc" or c in '<>"()\\' else c for c in t)


def spec_start(t):
    n = len(t) - len(t.lstrip("0123456789"))
    if t[:1] in ("#", ">") or t[:2] in ("- ", "+ ") or n and t[n : n + 2] in (". ", ") "):
        return t[:n] + "\\" + t[n:]
    return t


def spec_name(t):
    t = "".join("_" if c in '/\\:*?"<>|' or unicodedata.category(c) == "Cc" else c for c in t).strip().rstrip(".")
    return t or "sheet"


def spec_safe(t):
    for i, c in enumerate(t):
        if c in "/?#":
            return True
        if c == ":":
            return t[:i].lower() in ("http", "https", "mailto")
    return True


def spec_resolve(t):
    out = []
    for s in (t if t.startswith("/") else "a/b/" + t).split("/"):
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


@pytest.mark.parametrize(
    "spec, function",
    [
        (spec_escape, X.escape_text),
        (spec_url, X.escape_url),
        (spec_start, X.escape_block_start),
        (spec_name, X.safe_file_name),
        (spec_safe, X.is_safe_link),
        (lambda t: t.strip(), X.ustrip),
        (lambda t: t.replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>"), X.escape_cell),
        (lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\r\n') else t, lambda c: X.quote_field(c, ",")),
        (spec_resolve, lambda c: X.resolve_target(F.lit("a/b/c.xml"), F.regexp_replace(c, "[^./a]", "../"))),
    ],
)
def test_text(samples, spec, function):
    import re

    fix = (lambda t: re.sub("[^./a]", "../", t)) if spec is spec_resolve else (lambda t: t)
    assert [(t, v) for t, v in both(samples, function(F.col("t"))) if v != spec(fix(t))] == []


def test_json_text(samples):
    import json

    assert all(json.loads(v) == t for t, v in both(samples, numbers.json_text(F.col("t"))))


def test_numbers(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 3.0, 1e10, 1e21, 1e-7, 0.1 + 0.2, 2.0**53, -1.5, 123456.789] + [r.uniform(-1, 1) * 10 ** r.randint(-9, 15) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", numbers.float_text(F.col("v")).alias("t"), numbers.json_number(F.col("v")).alias("j"))
    for row in df.collect():
        v = values[row.i]
        assert row.t == value_text("float", v)
        assert float(row.j) == v and (("." not in row.j) if v == int(v) and abs(v) < 2**53 else True)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double").select(numbers.json_number(F.col("v")).alias("j"))
    assert [x.j for x in odd.collect()] == ["null", "null"]
    shown = {12345678.9: "12345678.9", 1.234e-5: "0.00001234", 1.2e-6: "1.2e-6", 1e17: "1e17", 1.5e300: "1.5e300", 2.0**53: "9007199254740992.0", -4.0: "-4", 1234567.25: "1234567.25"}
    typed = spark.createDataFrame([(v,) for v in shown], "v double").select("v", numbers.json_number(F.col("v")).alias("j"))
    assert {x.v: x.j for x in typed.collect()} == shown


def slow_keys(headers):
    out = []
    for i, h in enumerate(headers, 1):
        base = h if h.strip() else f"column_{i}"
        key, n = base, 2
        while key in out:
            key, n = f"{base}_{n}", n + 1
        out.append(key)
    return out


def test_names():
    r = random.Random(4)
    for _ in range(2000):
        headers = [r.choice(["", " ", "a", "a_2", "a_3", "b", "column_1", "column_2", "a_2_2"]) for _ in range(r.randint(0, 9))]
        assert json_keys(headers) == slow_keys(headers)
    assert len(set(json_keys(["x"] * 100_000))) == 100_000
    assert file_names(["a.md", "A.md", "a.md", "é.md", "e\u0301.md", ".md", "b", "b"]) == ["a.md", "A-2.md", "a-3.md", "é.md", "e\u0301-2.md", ".md", "b", "b-2"]
    assert folded("É") == folded("e\u0301")


def test_images(spark):
    heads = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff\xe0", "gif": b"GIF89a", "webp": b"RIFF0000WEBP", "bmp": b"BM", "tiff": b"II*\0", "emf": b"\x01\0\0\0" + b"\0" * 36 + b" EMF", "wmf": b"\xd7\xcd\xc6\x9a", None: b"<svg/>"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "k string, c binary")
    assert all(r.k == r.f for r in df.select("k", X.image_format(F.col("c")).alias("f")).collect())


def test_runs(spark):
    schema = "i int, runs array<struct<text:string,bold:boolean,italic:boolean,link:string,kind:string,image_source:string,note:int>>"
    t = lambda text, bold=False, italic=False, link=None: (text, bold, italic, link, "text", None, None)
    rows = [(0, [t("a "), t("b", True), t("c", True), t(" d", True, True)]), (1, [t("x", link="u v"), t(" y ", True, link="u v"), ("", False, False, None, "note", None, 4)]), (2, []), (3, [t("  ")]), (4, [(" a \n b ", False, False, None, "image", "p(1).png", None)])]
    df = spark.createDataFrame(rows, schema)
    got = {r.i: r for r in df.select("i", runs.merge_runs(F.col("runs")).alias("m"), runs.render_inline(F.col("runs")).alias("md"), runs.is_blank(F.col("runs")).alias("blank")).collect()}
    assert [r["text"] for r in got[0].m] == ["a ", "bc", " d"]
    assert [got[i].md for i in range(5)] == ["a **b****c** ***d***", "[x **y**](u%20v) [^4]", "", "", "![a b](p%281%29.png)"]
    assert [got[i].blank for i in range(5)] == [False, False, True, True, False]


def test_tables(spark):
    rows = tables.as_rows(spark.createDataFrame([("a|b", 1.5), ("*", None)], "h_1 string, n double"), ["h_1"], "t")
    lines = [r.line for r in tables.markdown_rows(rows).orderBy("row_no", "seq").collect()]
    assert lines == ["| h\\_1 | n   |", "| ---- | --- |", "| \\*   |     |", "| a\\|b | 1.5 |"]
    assert [r.line for r in tables.delimited_rows(rows, ",").orderBy("row_no").collect()] == ["h_1,n", "*,", "a|b,1.5"]
    budget = tables.cell_budget(rows, 3).orderBy("row_no").collect()
    assert [(r.padded, r.over) for r in budget] == [(2, False), (4, True), (6, True)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def balances_match(spark, at, name):
    """The query's rows and its SQL's, over customers with a negative zero among their balances."""
    import duckdb

    from docspark import queries

    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT CAST(i AS BIGINT) AS c_custkey, 'C' || i AS c_name, CAST(i % 2 AS INT) AS c_nationkey, CAST(b AS DOUBLE) AS c_acctbal, 'M' AS c_mktsegment FROM (VALUES (1, '-0.0'), (2, '0'), (3, '-0.01'), (4, '-7'), (5, '1234567.25'), (6, '-0.0')) v(i, b)")
    con.execute(f"COPY customer TO '{at}/customer.parquet'")
    frame = queries.QUERIES[name](spark, str(at))
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    return sorted(map(tuple, frame.collect())), sorted(want)


def test_negative_zero_as_text(spark, tmp_path):
    got, want = balances_match(spark, tmp_path, "float_text_customer")
    assert got == want and (1, "0") in got


def test_negative_zero_in_a_workbook(spark, tmp_path):
    got, want = balances_match(spark, tmp_path, "xlsx_typed_roundtrip")
    assert got == want and ("nation-0", 3, "6,0,true,2000-01-07T12:00:00,M") in got
