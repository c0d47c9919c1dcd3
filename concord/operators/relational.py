"""Filters, joins, audits and aggregates over case tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def preferred(df: DataFrame, keys: Sequence[str], source: str, order: Sequence[str]) -> DataFrame:
    """One row per key, from the first of the sources in `order` that has it; other sources come last."""
    place = F.coalesce(*(F.when(F.col(source) == name, F.lit(i)) for i, name in enumerate(order)), F.lit(len(order)))
    return first_per_key(df, keys, [place, source])


def left_join_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Every row of left with the first row of right of its key."""
    return left.join(first_per_key(right, [key], order), key, "left")


def keep_views(df: DataFrame, site: str, view: str, keep: dict[str, Sequence[str] | None]) -> DataFrame:
    """Rows of a view that the site keeps; all of a site without a list."""
    named = {k: v for k, v in keep.items() if v}
    ok = reduce(lambda a, kv: a | ((F.col(site) == kv[0]) & F.col(view).isin(*kv[1])), named.items(), ~F.col(site).isin(*named) if named else F.lit(True))
    return df.filter(ok)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def any_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a label of 1 in some column."""
    return df.filter(F.exists(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: F.coalesce(x == 1.0, F.lit(False))))


def held_out(df: DataFrame, training: DataFrame, unit: str, split: str, parts: Sequence[str] = ("test", "valid")) -> DataFrame:
    """Rows of the evaluation parts whose unit is not in training."""
    return df.filter(F.col(split).isin(*parts)).join(training.select(unit).distinct(), unit, "left_anti")


def in_all(df: DataFrame, id_col: str, member: str) -> DataFrame:
    """Ids that every member has."""
    members = df.agg(F.countDistinct(member).alias("_all"))
    counted = df.groupBy(id_col).agg(F.countDistinct(member).alias("_n"))
    return counted.crossJoin(F.broadcast(members)).filter("_n = _all").select(id_col)  # one row


def same_group_pairs(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, a, b): the pairs of members of one group, a before b."""
    one = df.select(group, F.col(member).alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "b"), group).filter("a < b")


def long_findings(df: DataFrame, id_cols: Sequence[str], findings: Sequence[str]) -> DataFrame:
    """(ids, finding, value) with one row for each finding of a case."""
    return df.unpivot(list(id_cols), [F.col(f).cast("double").alias(f) for f in findings], "finding", "value")


def prevalence(df: DataFrame, findings: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of labelled, positive and negative cases of each finding, and its rounded prevalence."""
    long = long_findings(df, list(by), findings)
    n = F.count("value")
    positive = F.sum(F.when(F.col("value") == 1, 1).otherwise(0)).cast("long")
    negative = F.sum(F.when(F.col("value") == 0, 1).otherwise(0)).cast("long")
    return long.groupBy("finding", *by).agg(n.alias("n_labeled"), positive.alias("n_positive"), negative.alias("n_negative")).withColumn("prevalence", F.when(F.col("n_labeled") > 0, F.round(F.col("n_positive") / F.col("n_labeled"), 6)))


def comorbidity(df: DataFrame, id_col: str, finding: str) -> DataFrame:
    """(finding_a, finding_b, n_positive_a, n_positive_b, n_co_occurrence, n_union, jaccard) of every ordered pair.

    df holds one row for each positive (case, finding). Pairs come from the findings of each case.
    """
    rows = df.select(id_col, finding).distinct()
    sizes = rows.groupBy(finding).agg(F.count("*").alias("n"))
    a = rows.select(id_col, F.col(finding).alias("finding_a"))
    both = a.join(rows.select(id_col, F.col(finding).alias("finding_b")), id_col).groupBy("finding_a", "finding_b").agg(F.count("*").alias("n_co_occurrence"))
    left = sizes.select(F.col(finding).alias("finding_a"), F.col("n").alias("n_positive_a"))
    right = sizes.select(F.col(finding).alias("finding_b"), F.col("n").alias("n_positive_b"))
    every = left.crossJoin(right).join(both, ["finding_a", "finding_b"], "left").fillna(0, ["n_co_occurrence"])  # findings by findings, not cases
    union = F.col("n_positive_a") + F.col("n_positive_b") - F.col("n_co_occurrence")
    return every.withColumn("n_union", union).withColumn("jaccard", F.when(F.col("n_union") > 0, F.round(F.col("n_co_occurrence") / F.col("n_union"), 6)).otherwise(0.0))


def split_leaks(df: DataFrame, unit: str, split: str, by: Sequence[str] = ()) -> DataFrame:
    """Units whose rows lie in more than one split, with the number of splits."""
    return df.filter(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def largest_share(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Share of the most frequent value within each group."""
    return df.groupBy(*by, value).agg(F.count("*").alias("_n")).groupBy(*by).agg((F.max("_n") / F.sum("_n")).alias("largest_share"))


def summaries(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample standard deviation, median, quartiles and share above zero of each group."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.median(x).alias("median"),
        F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.75).alias("q75"), F.avg((x > 0).cast("double")).alias("share_positive"),
    )


def member_means(pairs: DataFrame, a: str, b: str, value: str, without: Column | None = None) -> DataFrame:
    """Mean of a pair value over the pairs of each member, which counts for both ends; pairs where `without` is true stay out."""
    kept = pairs.filter(~without) if without is not None else pairs
    both = kept.select(F.col(a).alias("member"), value).unionAll(kept.select(F.col(b).alias("member"), value))
    return both.groupBy("member").agg(F.avg(value).alias("mean_value"), F.count("*").alias("n_pairs"))


def level_spread(df: DataFrame, level: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Range of the level means, and mean of the standard deviations within levels."""
    means = df.groupBy(*by, level).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return means.groupBy(*by).agg((F.max("_mean") - F.min("_mean")).alias("level_range"), F.avg("_std").alias("mean_within_std"), F.count("*").alias("n_levels"))


def pair_means(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Mean by unordered pair."""
    return pairs.groupBy(F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def one_hot(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """df with a 0/1 column for every level but the first in order."""
    rest = sorted(levels)[1:]
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in rest))


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a column that a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def conform(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """The declared columns in their order, NULL where absent, then the others."""
    have = set(df.columns)
    first = [(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in declared.items()]
    return df.select(*first, *(F.col(c) for c in df.columns if c not in declared))


def patched(df: DataFrame, fixes: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """df with each (condition, column, value) applied; doing it twice changes nothing more if the values do not."""
    for condition, column, value in fixes:
        df = df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
    return df
