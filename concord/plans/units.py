"""Resumable work by units: what is there is kept, the rest is computed in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.sources.tables import _exists, moved_params, write_params, write_unit


def run_units(units: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, params: dict, unit: str = "unit") -> DataFrame:
    """All rows of the result at path, after the units that it lacks are computed.

    units has the column `unit`; compute gets those to do and returns rows with their unit. If the
    recorded parameters differ from params, everything is computed anew. A unit whose rows are
    empty is tried again by the next run.
    """
    spark = units.sparkSession
    fresh = moved_params(spark, path, params) == [] and _exists(spark, f"{path}/*")
    left = units
    if fresh:
        done = spark.read.parquet(path).select(F.col(unit).cast("string").alias(unit)).distinct()
        left = units.join(done, unit, "left_anti")
    if not fresh:
        compute(left).write.mode("overwrite").partitionBy(unit).parquet(path)
    elif not left.isEmpty():
        write_unit(compute(left), path, unit)
    write_params(spark, path, params)
    return spark.read.parquet(path)


def panel_pairs(panel: DataFrame, name: str = "encoder", group: str | None = None, ordered: bool = False) -> DataFrame:
    """Pairs of panel members, unordered or ordered, within their group if one is given. A panel is a few dozen rows."""
    a = panel.select(F.col(name).alias("a"), *( [F.col(group).alias("ga")] if group else []))
    b = panel.select(F.col(name).alias("b"), *( [F.col(group).alias("gb")] if group else []))
    pairs = a.crossJoin(b).filter(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))
    return pairs.filter("ga = gb").select("a", "b") if group else pairs


def runs(axes: dict[str, list], spark, keep=None) -> DataFrame:
    """Enumeration of runs: the product of the axes, filtered, with run_id of the parts joined by two underscores."""
    from itertools import product

    rows = [r for r in product(*axes.values()) if keep is None or keep(dict(zip(axes, r)))]
    df = spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"`{a}` string" for a in axes))
    return df.withColumn("run_id", F.concat_ws("__", *axes))


def missing_members(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that a complete family would have and found lacks."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def resolved(config: dict, passes: int = 10) -> dict:
    """A nested configuration with ${name} replaced by the value of that top-level or dotted name, until nothing changes."""
    import re

    def lookup(name: str):
        node = config
        for step in name.split("."):
            if not isinstance(node, dict) or step not in node:
                return None
            node = node[step]
        return node if not isinstance(node, (dict, list)) else None

    def walk(node):
        if isinstance(node, dict):
            return {k: walk(v) for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v) for v in node]
        if isinstance(node, str):
            return re.sub(r"\$\{([^}]+)\}", lambda m: m[0] if (v := lookup(m[1])) is None else str(v), node)
        return node

    for _ in range(passes):
        new = walk(config)
        if new == config:
            break
        config = new
    return config
