"""Line dedup with DataFrame functions only: lines found in many documents go from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stored

_STRIPPED = " \t\n\x0b\f\r"


def bare(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.btrim(line, F.lit(_STRIPPED))


def line_key(line: Column) -> Column:
    """A text that is equal for two lines if and only if they are equal when bare and with A-Z in lower case.

    The UTF-8 bytes are read as Latin-1 and put in lower case, several times faster than replacing letter by letter.
    Beyond A-Z this only moves lead bytes, each to one that another length of sequence has, so it merges no texts.
    """
    return F.lower(F.decode(bare(line).cast("binary"), "ISO-8859-1"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (doc_id, text_hash, n_lines, n_dropped, kept, row): each text without the lines that at least min_docs documents hold.

    Lines are exploded and normalised, each key travels as a 128-bit hash, its distinct documents are counted, and
    the positions of common lines come back to their document, which is put together again in order. Documents are
    told apart by doc_id; rows that repeat an id count once, and each keeps its own result. A null doc_id is one
    document. A null or empty text is one empty line, and an empty line has no key, so it always stays. ``row`` has
    all columns but text as they were, whatever their names; a very long text is split whole; an empty table gives an
    empty result.

    The common keys are a stored table, so that Spark knows their size: it broadcasts a small one, and otherwise both
    sides of the join are shuffles of its own, in which it splits the partition of a frequent line.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    lines = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    long_enough = lines.filter(bare(F.col("line")) != "" if min_chars <= 1 else F.char_length(bare(F.col("line"))) >= min_chars)
    # never null, so that no join adds a test for null, which would work out the key twice
    key = F.coalesce(F.unhex(F.md5(line_key(F.col("line")))), F.lit(b""))
    keyed = long_enough.select("doc_id", "text_hash", "at", key.alias("key"))
    seen = keyed.groupBy("key", "doc_id").count().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common = stored(seen.filter(F.col("n") >= min_docs).select("key"), "common_lines")
    hits = keyed.join(common, "key", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("at"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "at")
    own = own.withColumn("text_hash", F.xxhash64("text"))
    out = own.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    out, parts = out.withColumn("parts", F.split("text", "\n")), F.col("parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("at"))
    kept = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: parts[i]), "\n"))
    n_dropped = F.when(F.col("at").isNull(), 0).otherwise(F.size("at"))
    return out.select("doc_id", "text_hash", F.size(parts).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("kept"), "row")
