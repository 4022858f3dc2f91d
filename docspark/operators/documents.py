"""Blocks as Markdown: filters, images by join, and the rendered text of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import escape_block_start, escape_cell, hard_breaks, heading, list_item
from docspark.operators.runs import is_blank, merge_runs, render_inline


def without_furniture(blocks: DataFrame) -> DataFrame:
    """Headers and footers have no place in Markdown; they go before any image is looked up."""
    return blocks.filter(~F.col("section").isin("header", "footer"))


def resolve_images(blocks: DataFrame, images: DataFrame | None) -> DataFrame:
    """Image runs get the source under which their part was saved; the others go, and so do blocks left blank.

    A note's blocks stay, so that what refers to it still has something to refer to.

    images has (path, part, source). The parts of a document are few, so they join as one map by path.
    """
    if images is None:
        sources = F.create_map().cast("map<string,string>")
        joined = blocks.withColumn("sources", sources)
    else:
        maps = images.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("part", "source"))).alias("sources"))
        joined = blocks.join(maps, "path", "left")

    def resolved(runs: Column) -> Column:
        source = lambda r: F.try_element_at("sources", r["image_part"])
        kept = F.filter(runs, lambda r: (r["kind"] != "image") | source(r).isNotNull())
        return merge_runs(F.transform(kept, lambda r: r.withField("image_source", F.when(r["kind"] == "image", source(r)))))

    grid = F.transform("grid", lambda row: F.transform(row, lambda c: c.withField("runs", resolved(c["runs"]))))
    out = joined.withColumn("runs", resolved(F.col("runs"))).withColumn("grid", grid).drop("sources")
    return out.filter(F.col("kind").isin("table", "rule") | (F.col("section") == "note") | ~is_blank(F.col("runs")))


def shown_images(blocks: DataFrame) -> DataFrame:
    """(path, part) of the images that blocks show, each once."""
    cells = F.flatten(F.transform("grid", lambda row: F.flatten(F.transform(row, lambda c: c["runs"]))))
    runs = F.when(F.col("grid").isNull(), F.col("runs")).when(F.col("runs").isNull(), cells).otherwise(F.concat("runs", cells))
    return blocks.select("path", F.explode(runs).alias("r")).filter("r.kind = 'image' AND r.image_part IS NOT NULL").select("path", F.col("r.image_part").alias("part")).distinct()


def _table(grid: Column) -> Column:
    """A grid as a GFM table; covered cells are empty, ragged rows are padded."""
    width = F.array_max(F.transform(grid, F.size))
    rows = F.transform(grid, lambda row: F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: escape_cell(F.coalesce(render_inline(F.try_element_at(row, i)["runs"]), F.lit("")))))
    widths = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.char_length(F.element_at(r, i))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, lambda x, w: F.rpad(x, w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.element_at(rows, 1))), F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(width > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def block_markdown() -> Column:
    """A block's Markdown from its columns."""
    plain = F.transform("runs", lambda r: r.withField("bold", F.lit(False)))
    inline = hard_breaks(render_inline(F.col("runs")))
    return (
        F.when(F.col("kind") == "heading", heading(F.col("level"), render_inline(merge_runs(plain))))
        .when(F.col("kind") == "paragraph", escape_block_start(inline))
        .when(F.col("kind") == "list_item", list_item(F.col("level"), F.col("list_kind") == "numbered", inline))
        .when(F.col("kind") == "table", _table(F.col("grid")))
        .otherwise(F.lit("---"))
    )


def _joined(parts: Column) -> Column:
    """Blocks in order, a blank line between them but within lists."""
    n = F.size(parts)
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.concat(
                F.when(i == 1, F.lit("")).when((F.element_at(parts, i)["kind"] == "list_item") & (F.element_at(parts, F.greatest(i - 1, F.lit(1)))["kind"] == "list_item"), F.lit("\n")).otherwise(F.lit("\n\n")),
                F.element_at(parts, i)["md"],
            ),
        ),
        "",
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """(path, text): each document as Markdown. A note's blocks become one footnote, indented after its first line."""
    shown = without_furniture(blocks).withColumn("md", block_markdown())
    is_note = F.col("section") == "note"
    unit = F.when(is_note, F.col("section_no")).otherwise(F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "md")))
    units = shown.groupBy("path", unit.alias("unit")).agg(parts.alias("parts")).withColumn("md", _joined(F.col("parts")))
    lines = F.split(F.regexp_replace("md", r"(?U)\s+$", ""), "\n")
    tail = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.when(x == "", F.lit("\n")).otherwise(F.concat(F.lit("\n    "), x)))
    note = F.concat(F.lit("[^"), F.col("unit").cast("string"), F.lit("]: "), F.element_at(lines, 1), F.array_join(tail, ""))
    text = F.when(F.col("unit") > 0, note).otherwise(F.col("md"))
    whole = units.select("path", F.struct("unit", text.alias("t")).alias("u")).groupBy("path").agg(F.array_sort(F.collect_list("u")).alias("us"))
    return whole.select("path", F.concat(F.array_join(F.transform("us", lambda u: u["t"]), "\n\n"), F.lit("\n")).alias("text"))


def picture_lists(pictures: DataFrame, images: DataFrame) -> DataFrame:
    """(path, sheet_no, pictures): the saved pictures of each sheet as Markdown paragraphs, in their order.

    pictures has (path, sheet_no, seq, run), images (path, part, source); a picture whose part was not saved goes.
    """
    named = images.select("path", F.col("part").alias("own_part"), "source")
    shown = pictures.withColumn("own_part", F.col("run.image_part")).join(named, ["path", "own_part"])
    md = render_inline(F.array(F.col("run").withField("image_source", F.col("source"))))
    parts = F.array_sort(F.collect_list(F.struct("seq", md.alias("md"))))
    listed = shown.groupBy("path", "sheet_no").agg(parts.alias("parts"))
    return listed.select("path", "sheet_no", F.concat(F.array_join(F.transform("parts", lambda p: p["md"]), "\n\n"), F.lit("\n")).alias("pictures"))
