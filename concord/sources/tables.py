"""Readers and writers of case tables, lists of codes, unit rows and vectors.

Everything goes through Spark's own sources, so paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotReady(Exception):
    """An input is absent, which a later run may bring."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of a text file is valid UTF-8."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with header by its declared schema, in UTF-8, or in Latin-1 if it is not valid UTF-8. Cells without text are NULL."""
    encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, escape='"', enforceSchema=False, multiLine=False)
    return df.select(*columns) if columns else df


def read_sniffed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A CSV table whose separator is the semicolon if its first line has more of them than commas; None without the file."""
    if not _exists(spark, path):
        return None
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return read_csv(spark, path, schema, ";" if line.count(";") > line.count(",") else ",")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row count of malformed lines) of JSON lines; a malformed line is left out. path may be a pattern."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select(*(F.col(f"r.`{f.name}`") for f in fields)), parsed.agg(F.count_if(bad).alias("n_malformed"))


def read_codes(spark: SparkSession, path: str, first: int = 7, length: int = 8, shortest: int = 15) -> DataFrame:
    """Distinct normalised codes at fixed places of the lines of a text; short lines are left out."""
    from concord.functions.text import normal_code

    code = normal_code(F.substring("value", first, length))
    return spark.read.text(path).filter(F.length("value") >= shortest).select(code.alias("code")).filter("code <> ''").distinct()


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, class): files below a folder, by name only, with the name of the folder that holds each."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    return found.withColumn("class", F.element_at(F.split("path", "/"), -2))


def with_files(df: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose file exists, by the end of the path that both give."""
    tail = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    return df.join(files.select(tail(F.col("path")).alias("_path")).distinct(), tail(F.col(path)) == F.col("_path"), "left_semi")


def report_texts(spark: SparkSession, df: DataFrame, path: str, text: str, files: str) -> DataFrame:
    """df with `report`: the text of the file at `path` if there is one, else the text in the table; blank ones are left out."""
    whole = spark.read.text(files, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^[a-z]+:/*", "/").alias("_path"), F.col("value").alias("_value"))
    joined = df.join(whole, F.regexp_replace(path, "^[a-z]+:/*", "/") == F.col("_path"), "left")
    pick = lambda c: F.when(F.trim(c) != "", c)
    return joined.withColumn("report", F.coalesce(pick(F.col("_value")), pick(F.col(text)))).drop("_path", "_value").filter("report IS NOT NULL")


def read_npz(spark: SparkSession, path: str, encoder: Column, pool: Column) -> DataFrame:
    """(encoder, pool, case_id, embedding) from archives of an `embeddings` matrix and its `case_ids`.

    An archive is read by one task; large sets belong in Parquet, which this is the way into.
    """
    import io

    import numpy as np
    import pyarrow as pa

    schema = T.StructType.fromDDL("path string, case_id string, embedding array<float>")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    ids, m = [str(x) for x in z["case_ids"]], z["embeddings"].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), pa.array(list(m), pa.list_(pa.float32()))], names=schema.names)

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    return rows.select(encoder.alias("encoder"), pool.alias("pool"), "case_id", "embedding")


def shape(vectors: DataFrame, embedding: str = "embedding") -> tuple[int, int | None]:
    """(rows, components) of a vector table; fails if widths differ."""
    r = vectors.agg(F.count("*").alias("n"), F.min(F.size(embedding)).alias("lo"), F.max(F.size(embedding)).alias("hi")).first()
    if r.lo != r.hi:
        raise ValueError(f"vectors of {r.lo} to {r.hi} components")
    return r.n, r.lo


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), params: dict | None = None) -> None:
    """Parquet, partitioned, refused if empty; with params, a sidecar that says what the table was built from."""
    if df.isEmpty():
        raise NotReady(f"no rows for {path}")
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    if params is not None:
        write_params(df.sparkSession, path, params)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """A CSV folder with headers, refused if empty. It counts once Spark has committed it, with _SUCCESS; read_csv() reads it."""
    if df.isEmpty():
        raise NotReady(f"no rows for {path}")
    df.write.mode("overwrite").csv(path, header=True, sep=sep, encoding=encoding, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, NULL fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_unit(df: DataFrame, path: str, unit: str) -> None:
    """Rows of some units, replacing those units alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in sorted(value.items())}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_params(spark: SparkSession, path: str, params: dict) -> None:
    spark.createDataFrame([(json.dumps(_plain(params), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.params")


def moved_params(spark: SparkSession, path: str, params: dict) -> list[str] | None:
    """Keys in which the recorded parameters of a table differ from params; None without a record."""
    if not _exists(spark, f"{path}.params"):
        return None
    old = json.loads(spark.read.text(f"{path}.params").first()[0])
    new = _plain(params)
    return sorted(k for k in {*old, *new} if old.get(k) != new.get(k))


def is_valid(spark: SparkSession, path: str, params: dict) -> bool:
    """Whether a finished table stands at path that was built with these parameters. Without a record it does not count as valid."""
    return _exists(spark, f"{path}/_SUCCESS") and moved_params(spark, path, params) == []


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder, from their listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, digest): the 16-byte BLAKE2b of each file's bytes, in hex digits."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            digests = [hashlib.blake2b(x.as_py(), digest_size=16).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "digest"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content").mapInArrow(run, "path string, digest string")


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of files that are new, gone or of another size or time, between two fingerprints()."""
    old = before.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = now.join(old, F.col("path") == F.col("_path"), "full_outer")
    change = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "gone").when((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed")
    return both.select(F.coalesce("path", "_path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def stale_reason(spark: SparkSession, path: str, stage: str, regimes: dict[str, str | int]) -> str | None:
    """Why a table is not to be read: its record names another regime of its stage than the current one. None if it may be, if it is not there, or if the stage has no regime.

    A regime is the version of a stage's rules; it is a parameter `regime` of write_table().
    """
    if stage not in regimes or not _exists(spark, f"{path}/_SUCCESS"):
        return None
    got = json.loads(spark.read.text(f"{path}.params").first()[0]).get("regime") if _exists(spark, f"{path}.params") else None
    if got == regimes[stage]:
        return None
    return f"{path.rstrip('/').rsplit('/', 1)[-1]} was written under regime {got!r} of {stage}, and the current one is {regimes[stage]!r}"
