"""op10: the quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.langid import held_out
from concord.llm.quality import fit, score


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, machine, keeps=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
