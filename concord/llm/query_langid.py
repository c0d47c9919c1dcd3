"""op3: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.langid import fit, held_out, predict


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    return predict(docs, model, keeps=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
