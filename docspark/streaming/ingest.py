"""New files of a folder as a stream: the same parsers, once for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.plans.plan import Options
from docspark.sources.files import errors, good, read_blocks, read_tables, refused, with_kind

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files (path, length, content); the source's checkpoint remembers which were read, however late they come."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "length", "content")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Tables, blocks and errors of new files as Parquet folders under ``out``; returns the running query.

    A batch writes folders of its own number, so one that is tried again replaces what it wrote before. Each file gives
    rows of its table or blocks, or a row of errors. Files with the same contents under two names are two files.
    """

    def write(files: DataFrame, batch: int) -> None:
        known = with_kind(files)
        tables, blocks = read_tables(known), read_blocks(known)
        failed = errors(tables).unionByName(errors(blocks)).unionByName(refused(known, Options("markdown")))
        for name, rows in (("tables", good(tables)), ("blocks", good(blocks)), ("errors", failed)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")

    return stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
