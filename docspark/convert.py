"""Converting files: the plan, the readers and the writers put together, and the command line."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from contextlib import nullcontext
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.numbers import json_text
from docspark.functions.text import safe_file_name
from docspark.operators import documents, pdf, sinks, tables
from docspark.operators.names import file_names, json_keys_column
from docspark.plans.plan import INPUTS, ConvertError, Options, check_options, output_format, plan
from docspark.sources import files as sources

EXTENSIONS = {"csv": "csv", "tsv": "tsv", "json": "json", "markdown": "md", "pdf": "pdf"}


def table_text(rows: DataFrame, to: str, typed: bool = False) -> DataFrame:
    """(path, sheet_no, text): whole tables rendered; lines are joined in order within their own sheet.

    A table without any row is an empty text, and an empty list as JSON.
    """
    if to == "json":
        keys = rows.filter("row_no = 0").select("path", "sheet_no", tables.texts(F.col("cells")).alias("headers"))
        wide = rows.join(rows.groupBy("path", "sheet_no").agg(F.max(F.size("cells")).alias("width")), ["path", "sheet_no"]).join(keys, ["path", "sheet_no"])
        named = wide.withColumn("headers", F.concat("headers", F.array_repeat(F.lit(""), F.col("width") - F.size("headers"))))
        named = named.withColumn("keys", json_keys_column(F.col("headers"))).filter("row_no > 0")
        padded = tables.pad(F.col("cells"), F.col("width"))
        pairs = F.zip_with("keys", padded, lambda k, c: F.concat(F.lit("    "), json_text(k), F.lit(": "), tables.json_cell(c, typed)))
        lines = named.select("path", "sheet_no", "row_no", F.lit(0).alias("seq"), F.concat(F.lit("  {\n"), F.array_join(pairs, ",\n"), F.lit("\n  }")).alias("line"))
        every = rows.select("path", "sheet_no").distinct().join(_joined(lines, ",\n"), ["path", "sheet_no"], "left")
        return every.select("path", "sheet_no", F.when(F.col("body").isNull(), F.lit("[]\n")).otherwise(F.concat(F.lit("[\n"), "body", F.lit("\n]\n"))).alias("text"))
    full = rows.filter(F.size("cells") > 0)
    lines = tables.markdown_rows(full) if to == "markdown" else tables.delimited_rows(full, "\t" if to == "tsv" else ",").withColumn("seq", F.lit(0))
    every = rows.filter("row_no = 0").select("path", "sheet_no").join(_joined(lines, "\n"), ["path", "sheet_no"], "left")
    return every.select("path", "sheet_no", F.when(F.col("body").isNull(), F.lit("")).otherwise(F.concat("body", F.lit("\n"))).alias("text"))


def _joined(lines: DataFrame, glue: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("row_no", "seq", "line")))
    return lines.groupBy("path", "sheet_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), glue).alias("body"))


def convert(spark: SparkSession, paths: str | list[str], options: Options) -> tuple[DataFrame, DataFrame]:
    """(results, errors): rendered files (path, sheet_no, sheet, text) and a row for each input that failed.

    Each file is planned by its own kind: one that does not fit the options is refused, and every input is either among
    the results or among the errors. Rows of PDF also say which characters the fonts lack, the first ten of them and how
    many more, and how many images are left out.
    """
    check_options(options)
    to = output_format(options.to)
    found = sources.with_kind(sources.scan(spark, paths), options.from_)
    files, refused = sources.accepted(found, options), sources.refused(found, options)
    if to == "pdf":
        docs, decks = (sources.read_blocks(files.filter(F.col("kind") == k), not options.no_notes) for k in ("docx", "pptx"))
        images = sources.good(sources.read_images(files))
        rendered = pdf.pdf(sources.good(docs), images=images).unionByName(pdf.pdf(sources.good(decks), slides=True, images=images))
        failed = sources.errors(docs).unionByName(sources.errors(decks))
        return rendered.select("path", F.lit(0).alias("sheet_no"), F.lit(None).cast("string").alias("sheet"), "text", "missing", "more", "skipped"), failed.unionByName(refused)
    parsed = sources.read_tables(files, options.sheet)
    rows = sources.good(parsed)
    if not options.all_sheets and options.sheet is None:
        rows = rows.filter("sheet_no = 0")
    names = rows.filter("row_no = 0").select("path", "sheet_no", "sheet")
    out = table_text(rows, to, options.typed).join(names, ["path", "sheet_no"]).select("path", "sheet_no", "sheet", "text")
    failed = sources.errors(parsed)
    if to == "markdown":
        blocks = sources.read_blocks(files, not options.no_notes)
        shown = sources.good(blocks)
        images = None
        if options.images:
            pictures = sources.good(sources.read_pictures(files, options.sheet))
            images = sinks.name_images(_wanted_images(files, shown, pictures, options)[0], options.images)
            listed = documents.picture_lists(pictures, images)
            after = F.when(F.col("pictures").isNull(), F.lit("")).when(F.col("text") == "", F.col("pictures")).otherwise(F.concat(F.lit("\n"), "pictures"))
            out = out.join(listed, ["path", "sheet_no"], "left").select("path", "sheet_no", "sheet", F.concat("text", after).alias("text"))
        text = documents.markdown(documents.resolve_images(documents.without_furniture(shown), images))
        out = out.unionByName(text.select("path", F.lit(0).alias("sheet_no"), F.lit(None).cast("string").alias("sheet"), "text"))
        failed = failed.unionByName(sources.errors(blocks))
    return out, failed.unionByName(refused)


def _wanted_images(files: DataFrame, shown: DataFrame, pictures: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(images, wanted): the images that the Markdown links to, and (path, part) of those that it would."""
    if options.sheet is None and not options.all_sheets:
        pictures = pictures.filter("sheet_no = 0")
    wanted = documents.shown_images(documents.without_furniture(shown)).unionByName(pictures.select("path", F.col("run.image_part").alias("part")).distinct())
    return sources.good(sources.read_images(files)).join(wanted, ["path", "part"], "left_semi"), wanted


def export_images(spark: SparkSession, paths: str | list[str], options: Options, folder: str) -> DataFrame:
    """Write the images that convert's inputs show into folder, by the names in Markdown's links: (path, saved, skipped).

    Tables in other formats have no links, but their pictures are written too. options.images is what the links begin with: the way from the Markdown's folder to this one.
    """
    files = sources.accepted(sources.with_kind(sources.scan(spark, paths), options.from_), options)
    shown = sources.good(sources.read_blocks(files, not options.no_notes))
    images, wanted = _wanted_images(files, shown, sources.good(sources.read_pictures(files, options.sheet)), options)
    os.makedirs(folder, exist_ok=True)
    sinks.write_images(images, sinks.name_images(images, options.images or ""), folder)
    return sinks.report(images, wanted)


def output_names(results: DataFrame, to: str, all_sheets: bool = False) -> DataFrame:
    """results with a file name each, unique among the sheets of a workbook."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    base = F.when(F.lit(all_sheets) & F.col("sheet").isNotNull(), F.concat(stem, F.lit("-"), safe_file_name(F.col("sheet")))).otherwise(stem)

    def claim(pdf):
        pdf = pdf.sort_values("sheet_no").reset_index(drop=True)
        pdf["name"] = file_names(f"{b}.{EXTENSIONS[to]}" for b in pdf["base"])
        return pdf[["path", "sheet_no", "name"]]

    named = results.select("path", "sheet_no", base.alias("base")).groupBy("path").applyInPandas(claim, "path string, sheet_no int, name string")
    return results.join(named, ["path", "sheet_no"])


#: Bytes that the command line takes from a pipe.
STDIN_LIMIT = 1 << 30


def _from_stdin(folder: tempfile.TemporaryDirectory) -> str:
    """What is piped in, as a file of the name stdin."""
    if sys.stdin.isatty():
        raise ConvertError("usage", "nothing is piped in")
    data = sys.stdin.buffer.read(STDIN_LIMIT + 1)
    if len(data) > STDIN_LIMIT:
        raise ConvertError("data", f"what is piped in is over {STDIN_LIMIT >> 20} MB")
    if not data:
        raise ConvertError("data", "what is piped in is empty")
    at = os.path.join(folder.name, "stdin")
    with open(at, "wb") as out:
        out.write(data)
    return at


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docspark")
    p.add_argument("input")
    p.add_argument("--from", dest="from_", choices=["xlsx", "docx", "pptx", "csv", "tsv"])
    p.add_argument("--to", required=True)
    p.add_argument("-o", "--output")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--sheet")
    which.add_argument("--all-sheets", action="store_true")
    p.add_argument("--typed", action="store_true")
    p.add_argument("--no-notes", action="store_true")
    p.add_argument("--images")
    a = p.parse_args(argv)
    held: list[tempfile.TemporaryDirectory] = []
    options = Options(a.to, a.from_, a.sheet, a.all_sheets, a.typed, a.no_notes, a.images, a.output, sys.stdout.isatty())
    try:
        check_options(options)
        if a.input == "-":
            a.input = _from_stdin(holder := tempfile.TemporaryDirectory())
            held.append(holder)
        elif not os.path.isfile(a.input):
            raise ConvertError("no_input", f"{a.input} does not exist")
        if a.output:
            sinks.check_not_input(a.output, [a.input])
        from docspark.sources import opc

        known = a.input.lower().rpartition(".")[2] if not held else ""
        kind = a.from_ or (known if known in INPUTS else None)
        if kind is None or a.from_:
            with open(a.input, "rb") as f:
                found = opc.sniff(f.read())
            if a.from_ and (found or "") != (a.from_ if a.from_ in ("xlsx", "docx", "pptx") else ""):
                raise ConvertError("data", f"{a.input} is not {a.from_}")
            kind = kind or found
        if kind is None:
            raise ConvertError("data", f"{a.input} is of no known kind")
        plan(kind, options)
        if a.images:
            beside = (a.output if a.all_sheets else os.path.dirname(a.output)) if a.output else ""
            options = replace(options, images=os.path.relpath(a.images, beside or ".").replace(os.sep, "/"))
        spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
        options = replace(options, from_=kind)
        results, failed = convert(spark, a.input, options)
        for row in failed.collect():
            raise ConvertError(row["class"], row["message"])
        to = output_format(a.to)
        if a.images:
            try:
                counts = export_images(spark, a.input, options, a.images).agg(F.sum("saved"), F.sum("skipped")).first()
            except OSError as bad:
                raise ConvertError("io", f"{a.images}: {bad.strerror}") from bad
            print(f"saved {counts[0] or 0} images to {a.images}", file=sys.stderr)
            if counts[1]:
                print(f"warning: left out {counts[1]} files that aren't PNG, JPEG, GIF, WebP, BMP, TIFF, EMF or WMF images", file=sys.stderr)
        if a.all_sheets:
            named = output_names(results, to, True)
            sinks.write_text(named, a.output or ".")
            for row in named.orderBy("sheet_no").select("name").toLocalIterator():
                print(f"wrote {os.path.join(a.output or '.', row['name'])}", file=sys.stderr)
        else:
            with open(a.output, "wb") if a.output else nullcontext(sys.stdout.buffer) as out:
                for row in results.orderBy("sheet_no").toLocalIterator():
                    out.write(bytes(row["text"]) if to == "pdf" else row["text"].encode())
                    if to == "pdf" and row["missing"]:
                        print(f"warning: no glyphs for {' '.join(row['missing'])}" + (f" and {row['more']} more" if row["more"] else ""), file=sys.stderr)
                    if to == "pdf" and row["skipped"]:
                        print(f"warning: left out {row['skipped']} images", file=sys.stderr)
    except ConvertError as bad:
        print(f"docspark: {bad.message}", file=sys.stderr)
        return bad.code
    except BrokenPipeError:
        return 0
    finally:
        for holder in held:
            holder.cleanup()
    return 0
