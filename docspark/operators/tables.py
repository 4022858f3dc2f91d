"""Tables as rows of cells: padding, widths, budgets, and rendering as delimited text, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.numbers import float_text, json_number, json_text
from docspark.functions.text import delimited_row, escape_cell, escape_text
from docspark.plans.ranges import running

CELL = "struct<kind:string,text:string,i:bigint,f:double,b:boolean>"


def cell(column: Column, kind: T.DataType) -> Column:
    """A typed value as a cell: its kind, its printed form, and the value."""
    none = {"i": F.lit(None).cast("long"), "f": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}
    if isinstance(kind, T.BooleanType):
        name, text, none["b"] = "bool", column.cast("string"), column
    elif isinstance(kind, T.IntegralType):
        name, text, none["i"] = "int", column.cast("string"), column.cast("long")
    elif isinstance(kind, T.FractionalType):
        name, text, none["f"] = "float", float_text(column.cast("double")), column.cast("double")
    else:
        name, text = "text", column.cast("string")
    return F.struct(F.when(column.isNull(), "empty").otherwise(F.lit(name)).alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none["i"].alias("i"), none["f"].alias("f"), none["b"].alias("b"))


def as_rows(df: DataFrame, order: list[str], path: str = "table") -> DataFrame:
    """A DataFrame as table_rows (path, sheet_no, row_no, cells); row 0 is the header. Rows are numbered range by range."""
    cells = F.array(*[cell(F.col(f.name), f.dataType) for f in df.schema.fields])
    made = df.select(F.lit(path).alias("path"), F.lit(0).alias("sheet_no"), F.struct(*order).alias("_order"), F.col(order[0]).alias("_first"), cells.alias("cells"))
    body = running(made, ["path", "sheet_no"], ["_first", "_order"], row_no=("sum", F.lit(1).cast("long"))).select("path", "sheet_no", "row_no", "cells")
    head = F.array(*[cell(F.lit(c), T.StringType()) for c in df.columns])
    return df.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(0).alias("sheet_no"), F.lit(0).cast("long").alias("row_no"), head.alias("cells")).unionByName(body)


def pad(cells: Column, width: Column) -> Column:
    """Rows shorter than the table get empty cells."""
    empty = F.from_json(F.lit('{"kind":"empty","text":""}'), CELL)
    return F.concat(cells, F.array_repeat(empty, F.greatest(width - F.size(cells), F.lit(0))))


def texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["text"])


def widths(rows: DataFrame, escape: bool = True) -> DataFrame:
    """(path, sheet_no, width, widths): the number of columns and each one's longest text, 3 at least.

    One partial aggregate by (path, sheet, column), so a large sheet is never gathered.
    """
    text = escape_cell(escape_text(F.col("c.text"))) if escape else F.col("c.text")
    by_column = rows.select("path", "sheet_no", F.posexplode("cells").alias("col", "c")).groupBy("path", "sheet_no", "col").agg(F.greatest(F.lit(3), F.max(F.char_length(text))).alias("w"))
    return by_column.groupBy("path", "sheet_no").agg(F.count(F.lit(1)).cast("int").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("col", "w"))), lambda x: x["w"]).alias("widths"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(path, sheet_no, row_no, line): a GFM table; the rule under the header has row_no 0 and seq 1."""
    wide = rows.join(widths(rows), ["path", "sheet_no"])
    shown = F.transform(texts(pad(F.col("cells"), F.col("width"))), lambda x: escape_cell(escape_text(x)))
    padded = F.zip_with(shown, F.col("widths"), lambda x, w: F.rpad(x, w, " "))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("widths", lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    lines = F.when(F.col("row_no") == 0, F.array(line, rule)).otherwise(F.array(line))
    return wide.select("path", "sheet_no", "row_no", F.posexplode(lines).alias("seq", "line"))


def delimited_rows(rows: DataFrame, delimiter: str) -> DataFrame:
    wide = rows.join(rows.groupBy("path", "sheet_no").agg(F.max(F.size("cells")).alias("width")), ["path", "sheet_no"])
    return wide.select("path", "sheet_no", "row_no", delimited_row(texts(pad(F.col("cells"), F.col("width"))), delimiter).alias("line"))


def json_cell(c: Column, typed: bool) -> Column:
    if not typed:
        return json_text(c["text"])
    return F.when(c["kind"] == "empty", F.lit("null")).when(c["kind"] == "int", c["i"].cast("string")).when(c["kind"] == "float", json_number(c["f"])).when(c["kind"] == "bool", c["b"].cast("string")).otherwise(json_text(c["text"]))


def json_rows(rows: DataFrame, keys: list[str], typed: bool = False) -> DataFrame:
    """(path, sheet_no, row_no, line): one pretty-printed object for each body row, keys in column order."""
    body = rows.filter("row_no > 0")
    padded = pad(F.col("cells"), F.lit(len(keys)))
    pairs = [F.concat(F.lit("    "), json_text(F.lit(k)), F.lit(": "), json_cell(padded[i], typed)) for i, k in enumerate(keys)]
    line = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *pairs), F.lit("\n  }"))
    return body.select("path", "sheet_no", "row_no", line.alias("line"))


def cell_budget(rows: DataFrame, limit: int, by: str = "path", order: str = "row_no") -> DataFrame:
    """rows with the padded cells so far (widest row so far times rows so far) and whether that is over the limit."""
    out = running(rows, [by], [order], _widest=("max", F.size("cells")), _rows=("sum", F.lit(1).cast("long")))
    return out.withColumn("padded", F.col("_widest").cast("long") * F.col("_rows")).withColumn("over", F.col("padded") > limit).drop("_widest", "_rows")
