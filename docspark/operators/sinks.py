"""Writing results: one named file for each sheet or document, and images by part."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import safe_file_name
from docspark.operators.names import file_names, folded
from docspark.plans.plan import ConvertError

MARKS = {"png": ["png"], "jpeg": ["jpg", "jpeg"], "gif": ["gif"], "webp": ["webp"], "bmp": ["bmp"], "tiff": ["tiff", "tif"], "emf": ["emf"], "wmf": ["wmf"]}


def check_not_input(output: str, inputs: list[str]) -> None:
    """An output never overwrites an input, under whatever name."""
    for path in inputs:
        if os.path.exists(output) and os.path.exists(path) and os.path.samefile(output, path):
            raise ConvertError("usage", f"{output} is the input")


def write_text(rendered: DataFrame, folder: str) -> None:
    """Rendered rows (name, text) to files of that name; tasks write their own rows, nothing is collected.

    The folder must be one that all executors share.
    """
    folder = os.path.abspath(folder)

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            data = row["text"] if isinstance(row["text"], (bytes, bytearray)) else row["text"].encode()
            with open(os.path.join(folder, row["name"]), "wb") as out:
                out.write(data)

    rendered.select("name", "text").foreachPartition(run)


def image_name(part: str, format_: str) -> str:
    """The part's file name, its extension replaced where it does not fit the format."""
    name = part.rpartition("/")[2]
    stem, dot, end = name.rpartition(".")
    return name if dot and end.lower() in MARKS[format_] else f"{stem if dot else name}.{MARKS[format_][0]}"


def name_images(images: DataFrame, folder: str) -> DataFrame:
    """images (path, part, format, sha2) with name and source, unique within a document and among all of them.

    The names of one document are claimed in one task. Where documents claim one name for unlike images, the first
    document keeps it, and the others' images go into folders named by their contents.
    """

    def run(key, pdf):
        pdf = pdf.sort_values("part").reset_index(drop=True)
        pdf["name"] = file_names(image_name(p, f) for p, f in zip(pdf["safe"], pdf["format"]))
        pdf["same"] = [folded(n) for n in pdf["name"]]
        return pdf.drop(columns="safe")

    safe = safe_file_name(F.element_at(F.split("part", "/"), -1))
    claimed = images.select("path", "part", "format", "sha2", safe.alias("safe")).groupBy("path").applyInPandas(run, "path string, part string, format string, sha2 string, name string, same string")
    first = claimed.groupBy("same").agg(F.min(F.struct("path", "part", "sha2"))["sha2"].alias("first"))
    name = F.when(F.col("sha2") == F.col("first"), F.col("name")).otherwise(F.concat("sha2", F.lit("/"), "name"))
    source = F.concat(F.lit(f"{folder}/" if folder else ""), "name")
    return claimed.join(first, "same").withColumn("name", name).select("path", "part", "format", "name", source.alias("source"))


def write_images(images: DataFrame, named: DataFrame, folder: str) -> None:
    """The bytes of images to files of their names; tasks write their own rows, nothing is collected.

    The folder must be one that all executors share.
    """
    folder = os.path.abspath(folder)

    def run(rows):
        for row in rows:
            at = os.path.join(folder, row["name"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            own = f"{at}.{uuid.uuid4().hex}"
            with open(own, "wb") as out:
                out.write(row["bytes"])
            os.replace(own, at)

    images.select("path", "part", "bytes").join(named.select("path", "part", "name"), ["path", "part"]).foreachPartition(run)


def report(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, saved, skipped): distinct image parts that were saved, and those shown but not saved."""
    shown = wanted.select("path", "part").distinct()
    saved = images.select("path", "part").distinct().withColumn("found", F.lit(1))
    return shown.join(saved, ["path", "part"], "left").groupBy("path").agg(F.count("found").alias("saved"), F.count_if(F.col("found").isNull()).alias("skipped"))
