"""op7: documents that hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.decontaminate import find_contamination


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keeps=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op7_benchmark_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows
), places AS (
  SELECT r, m, i, list_slice(w, i, i + m - 1) AS win FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
), hits AS (
  SELECT r, i, p.m, item FROM places p JOIN windows USING (m, win)
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + m - 1)) AS k FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
}
