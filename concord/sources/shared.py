"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no spark.checkpoint.dir.
LOCAL_DIR = "file:///tmp/checkpoints"

#: Folders made since the last clear().
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_DIR
    _made.append(f"{base.rstrip('/')}/concord-{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the folders made so far and says how many; results that are still to be read must be written before."""
    conf, jvm, n = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm, len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
