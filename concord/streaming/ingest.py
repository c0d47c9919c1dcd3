"""Incremental arrival of vectors: a stream of files appended to the vector table, once per case.

An extension: it replaces nothing, and lets a pool grow without being rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

VECTORS = T.StructType([T.StructField("encoder", T.StringType()), T.StructField("pool", T.StringType()), T.StructField("case_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def ingest_vectors(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append new Parquet files of vectors to target, partitioned by pool and encoder, without cases already there.

    A batch that runs again after a failure overwrites its own part, so nothing doubles.
    """

    def append(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["encoder", "pool", "case_id"])
        try:
            old = spark.read.parquet(target).filter(F.col("batch") != number)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(old.select("encoder", "pool", "case_id"), ["encoder", "pool", "case_id"], "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "pool", "encoder").parquet(target)

    stream = spark.readStream.schema(VECTORS).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
