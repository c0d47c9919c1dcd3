"""op4: classes of near-identical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.simhash import near_duplicate_classes


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
