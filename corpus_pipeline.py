"""A training corpus from documents: toxic ones go, common lines go, near copies go, personal data is replaced, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import stored
from docspark.llm.line_dedup import drop_common_lines
from docspark.llm.minhash import near_duplicates
from docspark.llm.packing import pack_documents
from docspark.llm.pii import replace_pii
from docspark.llm.queries import pii_key, word_bpe
from docspark.llm.toxicity import label_categories, score_toxicity

#: Documents are rejected from this probability on.
TOXIC = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose whole text has a probability of TOXIC or more to be toxic.

    A null or empty text has no features and is judged by the base rate; a very long one is scored whole. Rows that
    repeat an id are judged one by one; a null id stays. Other columns may have any names. No rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    scored = score_toxicity(docs.select("doc_id", "text", row), labels, label_categories()).filter(F.col("p_toxic") < TOXIC)
    return scored.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with texts that lost the lines which at least 10 documents hold; n_chars is counted again.

    Every row stays. A null text is one empty line and becomes an empty text. Rows that repeat an id count as one
    document for the lines; a null id is one document. Other columns may have any names. No rows give no rows.
    """
    out = drop_common_lines(docs, min_docs=10)
    return _measured(out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group of near copies (5-word shingles, similarity 0.8).

    Texts without words are no copies and stay. Rows that repeat an id with the same text are copies, of which one
    stays; those that repeat it with unlike texts are judged one by one. Rows without an id come last in a group. Other
    columns may have any names. No rows give no rows.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())  # of a written table, so the same each time
    near = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80).filter("NOT kept")
    copies = stored(near.select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")), "copies")
    members = copies.unionByName(copies.select(F.col("c").alias("r"), "c").distinct())
    ids = numbered.select(F.col(row).alias("r"), "doc_id").join(members, "r")
    first = ids.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r"))["r"].alias("r"))
    gone = ids.select("r").join(first, "r", "left_anti")
    return numbered.join(gone, numbered[row] == gone["r"], "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms for personal data, under the key of spark.docspark.pii.key; n_chars is counted again.

    Every row stays; a null text stays null. A column named pii stays as it was. No rows give no rows.
    """
    held = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    out = replace_pii(held, pii_key(spark))
    return _measured(out.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens; see pack_documents for odd rows."""
    return pack_documents(docs, word_bpe(), size=4096, end_id=2)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("pii", pii), ("packing", packing)]

#: The classifier, the signatures and the linear program are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
