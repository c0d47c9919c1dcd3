"""op13: one row of each group of equal texts stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.exactdedup import deduplicate


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLES = {
    "op13_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)"""
}
