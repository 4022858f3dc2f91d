"""A folder of files as DataFrames: kinds, tables, blocks, images, relationships and errors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docspark.functions.text import extension, image_format
from docspark.plans.plan import CODES, INPUTS, ConvertError, Options, plan
from docspark.sources import delimited, docx, opc, pptx, xlsx
from docspark.sources.blocks import BLOCKS, RUN

#: Bytes of a file that one row of Spark can hold; the package limits are stricter on what a file unpacks to.
CONTENT_LIMIT = (1 << 31) - (1 << 16)
CELL = "struct<kind:string,text:string,i:bigint,f:double,b:boolean>"
ERRORS = "path string, code int, class string, message string"
RELS = "path string, part string, id string, kind string, target string, external boolean"


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files as (path, length, content); one that no row can hold comes without content, and is refused later.

    Spark's reader leaves out files without a byte; they are added from the listing that the driver has anyway.
    """
    paths = [paths] if isinstance(paths, str) else paths
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    large = every.filter(F.col("length") > CONTENT_LIMIT).select("path", "length", F.lit(None).cast("binary").alias("content"))
    read = every.filter(F.col("length") <= CONTENT_LIMIT).select("path", "length", "content").unionByName(large)
    listed = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in every.inputFiles()]
    void = spark.createDataFrame(listed, "path string").join(every.select("path"), "path", "left_anti")
    return read.unionByName(void.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def with_kind(files: DataFrame, from_: str | None = None) -> DataFrame:
    """files with kind: by the option, else by a known extension (unopened), else by the package's contents."""
    by_name = F.when(extension(F.col("path")).isin("xlsx", "docx", "pptx", "csv", "tsv"), extension(F.col("path")))
    if from_ is not None:
        return files.withColumn("kind", F.lit(from_))

    @F.pandas_udf("string")
    def sniffed(content):
        return content.map(lambda c: opc.sniff(c) if c is not None else None)

    known = files.withColumn("kind", by_name)
    return known.filter("kind IS NOT NULL").unionByName(known.filter("kind IS NULL").withColumn("kind", sniffed("content")))


def refused(files: DataFrame, options: Options) -> DataFrame:
    """A row of errors for each file that is not read at all: too large, of no known kind, or not fit for the options."""
    reasons = {}
    for kind in INPUTS:
        try:
            plan(kind, options)
        except ConvertError as bad:
            reasons[kind] = (bad.kind, bad.message)
    known = F.col("kind").isin(*INPUTS)
    unknown, large = ("data", "of no known kind"), ("data", f"over {CONTENT_LIMIT >> 20} MB")
    pair = lambda reason: F.struct(F.lit(reason[0]).alias("class"), F.lit(reason[1]).alias("message"))
    why = F.when(F.col("content").isNull(), pair(large)).when(~F.coalesce(known, F.lit(False)), pair(unknown))
    for kind, reason in reasons.items():
        why = why.when(F.col("kind") == kind, pair(reason))
    code = F.create_map(*[F.lit(x) for item in CODES.items() for x in item])
    return files.select("path", why.alias("why")).filter("why IS NOT NULL").select("path", code[F.col("why.class")].alias("code"), "why.class", "why.message")


def accepted(files: DataFrame, options: Options) -> DataFrame:
    """The files that are not refused."""
    fit = []
    for kind in INPUTS:
        try:
            fit.append(plan(kind, options).kind)
        except ConvertError:
            continue
    return files.filter(F.col("content").isNotNull() & F.col("kind").isin(*fit))


def _parsed(files: DataFrame, parse: Callable[[str, str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Apply a parser file by file. A file that fails, in whatever way, gives one row with its error, and the job goes on.

    Parsers fail before they give their first row. Rows become Arrow columns a few thousand at a time.
    """
    whole = StructType.fromDDL(schema + f", error struct<{ERRORS.replace(' ', ':').replace(',:', ',')}>")
    arrow = to_arrow_schema(whole)
    names = [f.name for f in whole.fields]

    def tables(path, kind, content):
        try:
            rows = iter(parse(path, kind, content))
            while part := list(islice(rows, 5000)):
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in part], schema=arrow)
        except ConvertError as bad:
            yield failure(path, bad.kind, bad.message)
        except Exception as bad:  # a malformed file must not end the job; its error says what it was
            yield failure(path, "data", f"malformed: {type(bad).__name__}: {bad}")

    def failure(path, kind, message):
        return pa.RecordBatch.from_pylist([dict.fromkeys(names) | {"path": path, "error": {"path": path, "code": CODES[kind], "class": kind, "message": message}}], schema=arrow)

    def run(batches):
        for batch in batches:
            for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "content"))):
                yield from tables(path, kind, content)

    return files.filter("content IS NOT NULL").select("path", "kind", "content").mapInArrow(run, whole)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").drop("error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("error.*")


def _cell(kind: str, value) -> dict:
    from docspark.sources.text import value_text

    out = {"kind": kind, "text": value_text(kind, value), "i": None, "f": None, "b": None}
    if kind in ("float", "bool"):
        out[{"float": "f", "bool": "b"}[kind]] = value
    return out


def read_tables(files: DataFrame, sheet: str | None = None, bytes_limit: int = delimited.BYTES_LIMIT, cells_limit: int = delimited.CELLS_LIMIT) -> DataFrame:
    """table_rows (path, sheet_no, sheet, row_no, cells) with errors; row 0 is the header, without cells where a sheet is empty.

    files needs a kind.
    """

    def parse(path, kind, content):
        if kind in ("csv", "tsv"):
            rows = delimited.read_table(content, kind, bytes_limit, cells_limit)
            for i, row in enumerate(rows or [[]]):
                yield {"path": path, "sheet_no": 0, "sheet": None, "row_no": i, "cells": [_cell("text", v) for v in row]}
        else:
            for s in xlsx.read_workbook(content, sheet):
                for i, row in enumerate(s["rows"] or [[]]):
                    cells = [_cell(k, v) if i else _cell("text", _cell(k, v)["text"]) for k, v in row]
                    yield {"path": path, "sheet_no": s["sheet_no"], "sheet": s["sheet"], "row_no": i, "cells": cells}

    return _parsed(files.filter(F.col("kind").isin("csv", "tsv", "xlsx")), parse, f"path string, sheet_no int, sheet string, row_no long, cells array<{CELL}>")


def read_blocks(files: DataFrame, notes: bool = True) -> DataFrame:
    """blocks (path, section, section_no, seq, kind, level, align, list_kind, runs, grid) with errors."""

    def parse(path, kind, content):
        blocks, _ = docx.read_document(content) if kind == "docx" else pptx.read_deck(content, notes)
        for i, b in enumerate(blocks):
            yield b | {"path": path, "seq": i}

    return _parsed(files.filter(F.col("kind").isin("docx", "pptx")), parse, BLOCKS)


def read_relationships(files: DataFrame) -> DataFrame:
    """rels (path, part, id, kind, target, external) of all parts, with errors."""

    def parse(path, kind, content):
        archive, out = opc.Archive(content), []
        for name in sorted(archive.names):
            folder, _, file = name.rpartition("/")
            if folder.endswith("_rels") and file.endswith(".rels"):
                part = folder[: -len("_rels")] + file[: -len(".rels")]
                out += [{"path": path, "part": part, "id": i, "kind": r.kind, "target": r.target, "external": r.external} for i, r in archive.relationships(part).items()]
        return out

    return _parsed(files.filter(F.col("kind").isin("docx", "pptx", "xlsx")), parse, RELS)


def read_images(files: DataFrame) -> DataFrame:
    """images (path, part, format, bytes, sha2): each image part that a document shows, once; unknown formats stay out."""

    def parse(path, kind, content):
        if kind == "xlsx":
            archive = opc.Archive(content)
            runs = [p for s in xlsx.read_workbook(content, pictures=True) for p in s["pictures"]]
        else:
            blocks, archive = docx.read_document(content) if kind == "docx" else pptx.read_deck(content)
            runs = [r for b in blocks for r in [*b["runs"], *(r for row in b["grid"] or [] for c in row for r in c["runs"])]]
        found = [(part, archive.read(part)) for part in dict.fromkeys(r["image_part"] for r in runs if r["image_part"])]
        return [{"path": path, "part": part, "bytes": data} for part, data in found if data is not None]

    found = _parsed(files.filter(F.col("kind").isin("docx", "pptx", "xlsx")), parse, "path string, part string, bytes binary")
    known = found.withColumn("format", image_format(F.col("bytes"))).withColumn("sha2", F.sha2("bytes", 256))
    return known.filter("error IS NOT NULL OR format IS NOT NULL").select("path", "part", "format", "bytes", "sha2", "error")


def read_pictures(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """The pictures of sheets in order: (path, sheet_no, seq, run)."""

    def parse(path, kind, content):
        from docspark.sources.blocks import run

        for s in xlsx.read_workbook(content, sheet, pictures=True):
            for i, p in enumerate(s["pictures"]):
                yield {"path": path, "sheet_no": s["sheet_no"], "seq": i, "run": run(p["text"], "image", link=p["link"], image_part=p["image_part"], size=p["size"])}

    return _parsed(files.filter("kind = 'xlsx'"), parse, f"path string, sheet_no int, seq int, run {RUN}")
