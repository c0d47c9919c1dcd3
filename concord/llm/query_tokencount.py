"""op8: tokens of every document, counted in flat token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.tokencount import count_tokens, read_flat, write_flat


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, manifest = write_flat(docs, "text", ["doc_id"])
    counts = count_tokens(read_flat(spark, path))
    counts = counts.select(F.element_at(F.split("file", "/"), -1).alias("file"), "ordinal", "n_tokens", "closed")
    same = (F.col("of_file") == F.col("file")) & (F.col("of_ordinal") == F.col("ordinal"))
    return manifest.join(counts, same, "left").select("doc_id", "n_tokens", "closed")


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
