"""Places, running sums and ranks in an order of the whole table, without a window over all rows.

A table is range-partitioned by its order; windows stay inside a partition, and what the
partitions before hold is carried over as one number for each partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.sources.shared import cut


def spread(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df range-partitioned by `order`, with the number of each row's partition as `_part`; written, so that the numbers stay."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def same_group(by: Sequence[str]) -> Column:
    """Condition that columns `by` equal those that another table holds as _by_<name>; nulls equal nulls."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return out


def grouped_names(by: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"_by_{c}") for c in by]


def carried(placed: DataFrame, order: Sequence[str], amount: Column | str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """A spread() table with the sum of `amount` over the rows of its group that come before, in `out`; the group leads the order."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *by).agg(F.sum(amount).alias("_total"))
    before = F.coalesce(F.sum("_total").over(up_to(Window.partitionBy(*by).orderBy("_part"))), F.lit(0))  # one row a partition and group
    parts = totals.select(F.col("_part").alias("_of"), *grouped_names(by), before.alias("_carry"))
    inside = F.coalesce(F.sum(amount).over(up_to(Window.partitionBy("_part", *by).orderBy(*order))), F.lit(0))
    rows = placed.withColumn("_inside", inside).join(parts, (F.col("_part") == F.col("_of")) & same_group(by))
    return rows.withColumn(out, F.col("_carry") + F.col("_inside")).drop("_of", "_carry", "_inside", *(f"_by_{c}" for c in by))


def positions(df: DataFrame, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row, from 0, in the order of the whole table or of its group."""
    return carried(spread(df, [*by, *order]), order, F.lit(1), out, by).drop("_part")


def ranked(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the average rank of a value in the whole table or in its group: equal values share the mean of their ranks.

    df is read twice and must give the same values each time: write one whose values are computed.
    """
    counts = spread(df.groupBy(*by, value).agg(F.count("*").alias("_n")), [*by, value])
    placed = carried(counts, [value], "_n", "_before", by)
    ranks = placed.select(*grouped_names(by), F.col(value).alias("_value"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, same_group(by) & F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value", *(f"_by_{c}" for c in by))
