"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bpe import encode_documents
from docspark.llm.fingerprints import fingerprint_versions
from docspark.llm.lattice_dedup import link_embeddings
from docspark.llm.line_dedup import drop_common_lines
from docspark.llm.lm_scoring import score_documents
from docspark.llm.minhash import near_duplicates
from docspark.llm.packing import pack_documents
from docspark.llm.pii import replace_pii
from docspark.llm.substring_dedup import drop_repeated_passages
from docspark.llm.toxicity import label_categories, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), word_bpe())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe(), size=4096, end_id=2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_versions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: spark.docspark.pii.key, or a public one for tests."""
    return spark.conf.get("spark.docspark.pii.key", "docspark").encode()


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"), label_categories())
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


QUERIES = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_packing": op8_packing,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_fingerprints": op10_fingerprints,
}

#: ASCII lower-casing and stripping of a line, in DuckDB.
_KEY = "trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"

LINES_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{docs}}
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT doc_id, line, pos, {_KEY} AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, line, pos, key IN (SELECT key FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
FROM marked GROUP BY doc_id
"""

ORACLE = {"op3_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({LINES_SQL.format(docs='documents')})"}
