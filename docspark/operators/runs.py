"""Runs of text in order: merging neighbours, numbering, separators, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import escape_text, escape_url, split_edges, ustrip
from docspark.plans.ranges import running


def merge_neighbours(df: DataFrame, by: list[str], order: list[str], same: list[str], text: str = "text", glue: str = "") -> DataFrame:
    """Neighbouring rows with equal ``same`` columns become one: (by, island, same, text, n). Nulls equal each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("island", F.sum(F.when(first | changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy(*by, "island", *same).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("parts"), F.count(F.lit(1)).alias("n"))
    return grouped.select(*by, "island", *same, F.array_join(F.transform("parts", lambda p: p["t"]), glue).alias(text), "n")


def merge_runs(runs: Column) -> Column:
    """Within an array of runs, neighbouring text runs with the same style and link become one."""

    def step(out: Column, run: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        alike = (run["kind"] == "text") & (last["kind"] == "text") & (last["bold"] == run["bold"]) & (last["italic"] == run["italic"]) & last["link"].eqNullSafe(run["link"])
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(last.withField("text", F.concat(last["text"], run["text"]))))
        return F.when((F.size(out) > 0) & alike, joined).otherwise(F.concat(out, F.array(run)))

    return F.aggregate(runs, F.slice(runs, 1, 0), step)


def render_run(run: Column) -> Column:
    """A run as Markdown: emphasis marks stand inside the outer spaces; blanks take none."""
    edges = split_edges(run["text"])
    mark = F.when(run["bold"] & run["italic"], F.lit("***")).when(run["bold"], F.lit("**")).when(run["italic"], F.lit("*")).otherwise(F.lit(""))
    plain = F.concat(edges["lead"], mark, escape_text(edges["core"]), mark, edges["trail"])
    words = F.when(edges["core"] == "", run["text"]).otherwise(plain)
    alt = escape_text(ustrip(F.regexp_replace(run["text"], r"(?U)\s+", " ")))
    image = F.concat(F.lit("!["), alt, F.lit("]("), escape_url(F.coalesce(run["image_source"], F.lit(""))), F.lit(")"))
    return F.when(run["kind"] == "image", image).when(run["kind"] == "note", F.concat(F.lit("[^"), run["note"].cast("string"), F.lit("]"))).otherwise(words)


def render_inline(runs: Column) -> Column:
    """Runs in a row; neighbours with the same link share one link. The result has no outer blanks."""
    pieces = F.transform(runs, lambda r: F.struct(r["link"].alias("link"), render_run(r).alias("text")))

    def step(out: Column, piece: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(last.withField("text", F.concat(last["text"], piece["text"]))))
        return F.when((F.size(out) > 0) & last["link"].eqNullSafe(piece["link"]), joined).otherwise(F.concat(out, F.array(piece)))

    grouped = F.aggregate(pieces, F.slice(pieces, 1, 0), step)

    def link(p: Column) -> Column:
        edges = split_edges(p["text"])
        return F.when(p["link"].isNull() | (edges["core"] == ""), p["text"]).otherwise(F.concat(edges["lead"], F.lit("["), edges["core"], F.lit("]("), escape_url(p["link"]), F.lit(")"), edges["trail"]))

    return ustrip(F.array_join(F.transform(grouped, link), ""))


def is_blank(runs: Column) -> Column:
    """Nothing but white-space text; images, notes and fields count as content."""
    return ~F.exists(runs, lambda r: (r["kind"] != "text") | (ustrip(r["text"]) != ""))


def number_by_first(df: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Distinct keys numbered by their first place: (by, key, first, number). Each group aggregates before it is numbered."""
    firsts = df.groupBy(*by, key).agg(F.min(order).alias("first"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("first", key)))


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; rows with a null key are all kept."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    ranked = df.withColumn("_first", F.when(known, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).otherwise(F.lit(1)))
    return ranked.filter("_first = 1").drop("_first")


def running_budget(df: DataFrame, by: str, order: list[str], size: Column, limit: int) -> DataFrame:
    """df with the sizes used before and with each row, range by range of the first order column."""
    out = running(df.withColumn("_size", size), [by], order, used=("sum", F.col("_size")))
    return out.withColumn("left", F.greatest(F.lit(0), F.lit(limit) - (F.col("used") - F.col("_size")))).withColumn("over", F.col("used") > limit).drop("_size")
