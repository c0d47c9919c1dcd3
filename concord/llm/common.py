"""What the operators share: written steps, what a worker remembers, Arrow batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.sources.shared import cut

#: What this Python worker remembers between tasks.
_held: tuple[Hashable, Any] | None = None


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, kept between the tasks of a worker; it takes the place of one with another key.

    So the memory of a worker is bounded by one operator's, however many run one after another.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None
        _held = (key, make())
    return _held[1]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    return cut(df, label)


def spread_over(spark: SparkSession) -> int:
    """Partitions for rows that are few in bytes and take long: Spark joins small partitions by their bytes unless their number is given."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns of df under names that no operator uses, and the new name of each; named() gives the old names back."""
    names = {c: f"column_{i}" for i, c in enumerate(dict.fromkeys(columns))}
    return df.select(*(df[f"`{c}`"].alias(n) for c, n in names.items())), names


def named(df: DataFrame, names: dict[str, str], keeps: list[str]) -> DataFrame:
    """The numbered columns of `keeps` under their old names, before the other columns of df that are not numbered."""
    new = [c for c in df.columns if c not in names.values()]
    return df.select(*(F.col(names[c]).alias(c) for c in keeps), *(F.col(f"`{c}`") for c in new))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, pa.Array]], dict[str, pa.Array]]],
    reads: list[str],
    keeps: list[str],
    adds: list[T.StructField],
) -> DataFrame:
    """The columns `keeps` of df with new columns computed per Arrow batch.

    make() runs once in each task and returns the batch function: it gets the columns
    `reads` by name and returns the columns `adds`, row by row. A kept column that has
    the name of a new one is replaced by it.
    """
    new = [f.name for f in adds]
    keeps = [c for c in keeps if c not in new]
    inputs = list(dict.fromkeys([*keeps, *reads]))
    schema = T.StructType([*(df.schema[c] for c in keeps), *adds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(inputs)}
            out = fn({c: cols[c] for c in reads})
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in keeps), *(out[c] for c in new)], names=[*keeps, *new])

    return df.select(*(df[f"`{c}`"] for c in inputs)).mapInArrow(run, schema)
