"""Resampling inference: ranks, bootstrap, jackknife, permutation, false discovery.

Sums of replicates come from tasks that draw them on packed rows (operators/resampling.py), so no
row is copied for a replicate. replicated(), resampled(), subsampled() and permuted() give the rows
themselves, for statistics that are no sums; they are meant for tables of results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators import resampling as X
from concord.operators.order import carried, grouped_names, positions, ranked, same_group, spread
from concord.operators.sampling import hash_key, hash_number
from concord.sources.shared import cut

REPLICATES = 1000
#: About so many rows of a replicate are sorted at once.
PIECE = 50_000
#: Different values of a group that a task holds at most, about, where so many rows of one value count as one more.
PART_VALUES = 1 << 22
PART_COPIES = 8


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks over the rows that have both values."""
    both = cut(df.select(*dict.fromkeys([*by, x, y])).filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    both = ranked(ranked(both, x, "_rx", by), y, "_ry", by)
    return both.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def residual(df: DataFrame, y: str, z: str, out: str) -> DataFrame:
    """df with what a straight line in z leaves of y."""
    line = df.agg(F.regr_slope(y, z).alias("_slope"), F.regr_intercept(y, z).alias("_cut"))
    return df.crossJoin(F.broadcast(line)).withColumn(out, F.col(y) - (F.col("_cut") + F.col("_slope") * F.col(z))).drop("_slope", "_cut")  # one row


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of the residuals of x and y on z; NULL below five complete rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    found = spearman(residual(residual(rows, x, z, "_ex"), y, z, "_ey"), "_ex", "_ey")
    return found.select(F.when(F.col("n") >= 5, F.col("spearman")).alias("partial_spearman"), "n")


def slope(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.count("*").alias("n"))


def replicated(df: DataFrame, replicates: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with place i of each row, from 0, and their number n."""
    return positions(df, order, "i").crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))  # one row


def resampled(df: DataFrame, order: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Rows of df drawn with replacement, as many as there are, for every replicate b.

    Both sides are shuffled by place: Spark takes the draws for as small as the rows they are made of, and would broadcast them.
    """
    rows = numbered(df, order)
    draws = replicated(rows.select("i", "n"), replicates).select("b", F.pmod(hash_number(seed, F.col("b"), F.col("i")), F.col("n")).cast("int").alias("i"))
    return draws.join(rows.drop("n").hint("shuffle_hash"), "i").drop("i")


def _checked_clusters(df: DataFrame, cluster: str) -> DataFrame:
    absent = F.lower(F.trim(F.col(cluster).cast("string"))).isin("", "nan", "none") | F.col(cluster).isNull()
    return df.withColumn(cluster, F.when(absent, F.raise_error(F.lit("a row has no cluster"))).otherwise(F.col(cluster)))


def resampled_clusters(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """All rows of clusters drawn with replacement; a row without a cluster fails the query."""
    checked = _checked_clusters(df, cluster)
    clusters = numbered(checked.select(cluster).distinct(), [cluster])
    draws = replicated(clusters.select("i", "n"), replicates).select("b", F.pmod(hash_number(seed, F.col("b"), F.col("i")), F.col("n")).cast("int").alias("i"))
    drawn = draws.join(clusters.select("i", cluster).hint("shuffle_hash"), "i").groupBy("b", cluster).agg(F.count("*").alias("weight"))
    return drawn.join(checked, cluster)


def interval(draws: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Standard deviation and 95 % percentile interval of the replicates' values."""
    return draws.groupBy(*by).agg(F.stddev_samp(value).alias("std"), F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"), F.count(value).alias("n_draws"))


def spread_of(draws: np.ndarray) -> tuple[float | None, float | None, float | None, int]:
    """Standard deviation, 95 % percentile interval and number of the finite values."""
    good = draws[np.isfinite(draws)]
    if not len(good):
        return None, None, None, 0
    low, high = np.percentile(good, [2.5, 97.5])
    return (float(good.std(ddof=1)) if len(good) > 1 else None), float(low), float(high), len(good)


_SPREAD = "std double, ci_low double, ci_high double, n_draws long"


def _number(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


def _bootstrapped(df: DataFrame, values: np.ndarray, sizes: dict[str, int], extra: dict[str, float | None] | None = None) -> DataFrame:
    """One row: the table's value as point, sizes, the spread of the replicates' values."""
    extra = extra or {}
    schema = ", ".join(["point double", *(f"{c} long" for c in sizes), _SPREAD, *(f"{c} double" for c in extra)])
    return df.sparkSession.createDataFrame([(_number(values[0]), *sizes.values(), *spread_of(values[1:]), *extra.values())], schema)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return a / b


def bootstrap_mean(df: DataFrame, value: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Mean with its interval over as many rows drawn with replacement; NULL for an empty table."""
    cells = X.value_cells(df.filter(F.col(value).isNotNull()), [value])
    sums = X.bootstrap_sums(cells, lambda x: np.column_stack([x[:, 0], np.ones(len(x))]), 2, replicates, seed)
    return _bootstrapped(df, ratio(sums[:, 0], sums[:, 1]), {"n": cells.n})


def cluster_bootstrap_mean(df: DataFrame, value: str, cluster: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Mean of all rows of clusters drawn with replacement; a row without a cluster fails the query."""
    per = _checked_clusters(df.filter(F.col(value).isNotNull()).select(cluster, value), cluster).groupBy(cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    cells = X.value_cells(per, ["_s", "_c"])
    sums = X.bootstrap_sums(cells, lambda x: x, 2, replicates, seed)
    return _bootstrapped(df, ratio(sums[:, 0], sums[:, 1]), {"n": int(sums[0, 1])})


def paired_bootstrap(df: DataFrame, a: str, b: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Mean difference with its interval, and the share of draws as far from it as it is from zero, at least 1 / replicates."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    cells = X.value_cells(rows, ["d"])
    sums = X.bootstrap_sums(cells, lambda x: np.column_stack([x[:, 0], np.ones(len(x))]), 2, replicates, seed)
    values = ratio(sums[:, 0], sums[:, 1])
    share = float(X.at_least(np.abs(values[1:] - values[0]), abs(values[0])).mean()) if cells.n else None
    return _bootstrapped(df, values, {"n": cells.n}, {"p_value": None if share is None else max(share, 1.0 / replicates)})


def bootstrap_spearman(df: DataFrame, x: str, y: str, order: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Rank correlation with its interval. Every task holds the distinct pairs of values; beyond X.ENTRIES of them rows are copied, told apart by `order`."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*order, x, y]))
    if rows.select(x, y).distinct().count() > X.ENTRIES:
        draws = spearman(resampled(rows, order, replicates, seed), x, y, ["b"])
        return spearman(rows, x, y).withColumnRenamed("spearman", "point").crossJoin(interval(draws, "spearman"))  # one row each
    cells = X.value_cells(rows, [x, y])
    return _bootstrapped(df, X.bootstrap_rank_correlations(cells, replicates, seed), {"n": cells.n})


def bootstrap_slope(df: DataFrame, x: str, y: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Slope of a straight line with its interval; a draw in which x does not vary counts for none."""
    cells = X.value_cells(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y])
    sums = X.bootstrap_sums(cells, lambda v: np.column_stack([np.ones(len(v)), v, v[:, 0] * v[:, 1], v[:, 0] ** 2]), 5, replicates, seed)
    n, sx, sy, xy, xx = sums.T
    return _bootstrapped(df, ratio(n * xy - sx * sy, n * xx - sx * sx), {"n": cells.n})


def auroc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL with a single class."""
    rows = cut(df.select(*dict.fromkeys([*by, label, score])).filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()))
    rows = ranked(rows, score, "_r", by)
    pos = F.sum((F.col(label) == 1).cast("double"))
    neg = F.sum((F.col(label) == 0).cast("double"))
    total = F.sum(F.when(F.col(label) == 1, F.col("_r")).otherwise(0.0))
    return rows.groupBy(*by).agg(pos.alias("_p"), neg.alias("_q"), total.alias("_s")).select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * F.col("_q"))).alias("auroc"), F.col("_p").cast("long").alias("n_positive"), F.col("_q").cast("long").alias("n_negative"))


def bootstrap_auroc(df: DataFrame, label: str, score: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Area under the ROC curve with its interval; draws of a single class count for none."""
    rows = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    counts = {r.y: r.n for r in rows.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    cells = X.value_cells(rows, [score], label)
    return _bootstrapped(df, X.bootstrap_aurocs(cells, replicates, seed) if cells.n else np.full(1 + replicates, np.nan), {"n_positive": counts.get(1, 0), "n_negative": counts.get(0, 0)})


def subsample_mean(df: DataFrame, value: str, order: Sequence[str], m: int | None = None, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Mean of the means of m rows without replacement, 0.632 of them if m is not given, with its spread; NULL below four rows or if m is no part of them."""
    rows = X.placed_rows(df.filter(F.col(value).isNotNull()), order, [value])
    m = m or max(2, round(0.632 * rows.n))
    if rows.n < 4 or not 2 <= m <= rows.n:
        return df.sparkSession.createDataFrame([(None, rows.n, m, None, None, None, 0)], f"point double, n long, n_sub long, {_SPREAD}")
    draws = X.permuted_sums(rows, [m], replicates, seed)[1:, 0, 0] / m
    return df.sparkSession.createDataFrame([(float(draws.mean()), rows.n, m, *spread_of(draws))], f"point double, n long, n_sub long, {_SPREAD}")


def subsampled(df: DataFrame, id_col: str, m: int, replicates: int, seed: int) -> DataFrame:
    """m rows without replacement for every replicate b. Up to m of a thousand or so, a task passes on its own m best of a replicate."""
    place = F.row_number().over(Window.partitionBy("b").orderBy(hash_key(seed, F.col("b"), F.col(id_col)), id_col))
    return replicated(df, replicates).withColumn("_place", place).filter(F.col("_place") <= m).drop("_place")


def block_jackknife(df: DataFrame, value: str, id_col: str, blocks: int = 20, seed: int = 0) -> DataFrame:
    """Standard error of the mean by leaving out one of equal blocks at a time. Block sums stand for the rows."""
    rows = df.filter(F.col(value).isNotNull()).select(hash_key(seed, F.col(id_col)).alias("_key"), F.col(id_col).alias("_id"), F.col(value).alias("_x"))
    n = rows.count()
    longer, size = n % blocks, n // blocks  # the first blocks hold a row more
    at = F.col("_at")
    block = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / max(1, size)))
    per = positions(rows, ["_key", "_id"], "_at").groupBy(block.alias("block")).agg(F.sum("_x").alias("s"), F.count("*").alias("c"))
    every = per.agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"))
    left = per.crossJoin(F.broadcast(every)).select(((F.col("_s") - F.col("s")) / (F.col("_c") - F.col("c"))).alias("v"), (F.col("_s") / F.col("_c")).alias("point"))  # one row
    g = F.count("*")
    return left.agg(F.max("point").alias("point"), F.sqrt((g - 1) / g * F.var_pop("v") * g).alias("std"), g.alias("n_blocks")).withColumn("ci_low", F.col("point") - 1.96 * F.col("std")).withColumn("ci_high", F.col("point") + 1.96 * F.col("std"))


def jackknife_units(pairs: DataFrame, a: str, b: str, statistic: Column, least: int = 4) -> DataFrame:
    """Statistic of a pair table and its standard error by leaving out every pair that a unit is part of.

    statistic is an aggregate; deletions that leave fewer than `least` pairs do not count; the error
    is NULL below three deletions.
    """
    units = pairs.select(F.col(a).alias("unit")).union(pairs.select(F.col(b))).distinct()
    kept = pairs.join(units, (F.col(a) != F.col("unit")) & (F.col(b) != F.col("unit")))  # a result table by its few units
    left = kept.groupBy("unit").agg(statistic.alias("v"), F.count("*").alias("c")).filter((F.col("c") >= least) & F.col("v").isNotNull())
    g = F.count("*")
    error = left.agg(F.when(g >= 3, F.sqrt((g - 1) / g * F.var_pop("v") * g)).alias("std"), g.alias("n_units"))
    point = pairs.agg(F.when(F.count("*") >= least, statistic).alias("point"), F.count("*").alias("n"))
    return point.crossJoin(error).withColumn("ci_low", F.col("point") - 1.96 * F.col("std")).withColumn("ci_high", F.col("point") + 1.96 * F.col("std"))  # one row each


def normal_p(point: float | None, error: float | None) -> float | None:
    """Two-sided p of an estimate with a normal error; None without a positive one."""
    if point is None or not error or error <= 0:
        return None
    return 2 * NormalDist().cdf(-abs(point) / error)


def permuted(df: DataFrame, value: str, order: Sequence[str], replicates: int, seed: int, piece: int = PIECE) -> DataFrame:
    """Rows (b, i, value): the values of a table in a random order for every replicate.

    A replicate is sorted in pieces of about `piece` rows, which the first digits of the hash make;
    the rows before each piece come from counts.
    """
    rows = cut(positions(df.select(*dict.fromkeys([*order, value])), order, "i").select("i", value))
    n, digits = rows.count(), 0
    while n > piece * 16**digits:
        digits += 1
    keyed = replicated(rows, replicates).withColumn("_key", hash_key(seed, F.col("b"), F.col("i")))
    keyed = keyed.withColumn("_piece", F.substring("_key", 1, digits) if digits else F.lit(""))
    placed = keyed.withColumn("_place", F.row_number().over(Window.partitionBy("b", "_piece").orderBy("_key", "i")) - 1)
    if digits:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("b").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = keyed.groupBy("b", "_piece").agg(F.count("*").alias("_n")).select("b", "_piece", before.alias("_before"))
        placed = placed.join(counts, ["b", "_piece"]).withColumn("_place", F.col("_place") + F.col("_before"))
    return placed.select("b", F.col("_place").alias("i"), value)


#: Groups whose sums of all replicates the driver holds at most; rows are copied for more.
MOST_GROUPS = 512


def _share(draws: np.ndarray, value: float) -> float:
    """(draws that reach the value, plus one) / (draws plus one)."""
    return float((X.at_least(draws, value).sum() + 1) / (len(draws) + 1))


def permutation_two(df: DataFrame, value: str, group: str, first: str, order: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Two-sided permutation p of the difference of two group means, (count + 1) / (replicates + 1); NULL below two rows a group."""
    _, row = _two_groups(df, value, group, first, order, replicates, seed)
    return df.sparkSession.createDataFrame([row], "difference double, n_a long, n_b long, p_value double")


def _two_groups(df: DataFrame, value: str, group: str, first: str, order: Sequence[str], replicates: int, seed: int) -> tuple[tuple, tuple]:
    """((mean of the first group, of the others), (difference, n_a, n_b, p))."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*dict.fromkeys([*order, value]), (F.col(group) == first).alias("_first"))
    is_first = F.col("_first")
    n_a, n_b, a, b = rows.agg(F.count(F.when(is_first, 1)), F.count(F.when(~is_first, 1)), F.avg(F.when(is_first, F.col(value))), F.avg(F.when(~is_first, F.col(value)))).first()
    difference = None if a is None or b is None else a - b
    if min(n_a, n_b) < 2:
        return (a, b), (difference, n_a, n_b, None)
    sums = X.permuted_sums(X.placed_rows(rows, order, [value]), [n_a, n_b], replicates, seed)[1:, :, 0]
    draws = sums[:, 0] / n_a - sums[:, 1] / n_b
    return (a, b), (difference, n_a, n_b, _share(np.abs(draws), abs(difference)))


def two_group_report(df: DataFrame, value: str, group: str, first: str, order: Sequence[str], prefix: str = "diff", share: bool = True, tested: str = "", replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """permutation_two() under the names of reports; a share is shown in percent with a decimal."""
    (a, b), (difference, n_a, n_b, p) = _two_groups(df, value, group, first, order, replicates, seed)
    shown = lambda x: None if x is None else round(x * (100 if share else 1), 1)
    cells = {f"{prefix}_unit": "percentage_points" if share else "raw", f"{prefix}_mean": shown(difference), f"{prefix}_mean_raw": difference, f"{prefix}_group_a_mean": shown(a), f"{prefix}_group_b_mean": shown(b), "n_a": n_a, "n_b": n_b, "p_raw": p, "p_fdr": None, "tested": tested}
    kinds = {f"{prefix}_unit": "string", "n_a": "long", "n_b": "long", "tested": "string"}
    return df.sparkSession.createDataFrame([tuple(cells.values())], ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in cells))


def f_statistic(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way F of the groups from their sums."""
    per = df.groupBy(*by, group).agg(F.count("*").alias("c"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    n, k = F.sum("c"), F.count("*")
    grand = F.sum(F.col("c") * F.col("m")) / n
    between = F.sum(F.col("c") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum(F.col("c") * F.col("v"))
    return per.groupBy(*by).agg((between / (k - 1) / (within / (n - k))).alias("f"), k.alias("n_groups"), n.alias("n"))


def _large_groups(df: DataFrame, value: str, group: str) -> tuple[DataFrame, list]:
    """Rows with a value whose group has two or more, and (group, n, mean) of each in order, at most MOST_GROUPS + 1 of them."""
    rows = df.filter(F.col(value).isNotNull())
    sizes = cut(rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).filter("n >= 2"))
    kept = rows.join(sizes.select("_group"), F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    return kept, sizes.orderBy("_group").limit(MOST_GROUPS + 1).collect()


def _f_values(sums: np.ndarray, sizes: np.ndarray, squares: float) -> np.ndarray:
    """One-way F of each replicate from its groups' sums, given the sum of all squares."""
    n, k = sizes.sum(), len(sizes)
    between = (sums**2 / sizes).sum(1) - sums.sum(1) ** 2 / n
    total = squares - sums.sum(1) ** 2 / n
    return ratio(between / max(1, k - 1), (total - between) / (n - k)) if n > k > 1 else np.full(len(sums), np.nan)


def permutation_groups(df: DataFrame, value: str, group: str, order: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(f, n_groups, n, p_value): permutation p of the one-way F over groups of two or more rows; NULL below two groups."""
    rows, groups = _large_groups(df, value, group)
    if len(groups) > MOST_GROUPS:
        return _permutation_of_many(rows, value, group, order, replicates, seed)
    f, p = _f_test(rows, value, group, order, groups, replicates, seed)
    return df.sparkSession.createDataFrame([(f, len(groups), sum(g.n for g in groups), p)], "f double, n_groups long, n long, p_value double")


def _f_test(rows: DataFrame, value: str, group: str, order: Sequence[str], groups: list, replicates: int, seed: int) -> tuple[float | None, float | None]:
    if len(groups) < 2:
        return None, None
    squares = rows.agg(F.sum(F.col(value).cast("double") * F.col(value))).first()[0]
    sums = X.permuted_sums(X.placed_rows(rows, [group, *order], [value]), [g.n for g in groups], replicates, seed)[:, :, 0]
    values = _f_values(sums, np.array([g.n for g in groups], float), squares)
    return _number(values[0]), _share(values[1:], values[0]) if np.isfinite(values[0]) else None


def groups_report(df: DataFrame, value: str, group: str, order: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(k_groups, group_means_pct, p_raw, p_fdr): permutation_groups() under the names of reports, means in percent in the order of the groups."""
    rows, groups = _large_groups(df, value, group)
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"a report lists at most {MOST_GROUPS} groups")
    means = ";".join(str(round(g.mean * 100, 1)) for g in groups)
    return df.sparkSession.createDataFrame([(len(groups), means, _f_test(rows, value, group, order, groups, replicates, seed)[1], None)], "k_groups long, group_means_pct string, p_raw double, p_fdr double")


def _permutation_of_many(rows: DataFrame, value: str, group: str, order: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """permutation_groups() for any number of groups, with a row for each row and replicate."""
    observed = f_statistic(rows, value, group)
    places = numbered(rows, [group, *order]).select("i", group)
    moved = permuted(rows, value, [group, *order], replicates, seed).join(places.hint("shuffle_hash"), "i")
    draws = f_statistic(moved, value, group, ["b"]).select(F.col("f").alias("draw"))
    p = draws.crossJoin(F.broadcast(observed)).agg(((F.sum((F.col("draw") >= F.col("f")).cast("long")) + 1) / (F.count("*") + 1.0)).alias("p_value"))  # one row
    return observed.crossJoin(p)


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "p_fdr") -> DataFrame:
    """df with the adjusted p-values of each family and whether they lie below 0.05; NULL p stays NULL.

    The work is on the distinct p-values of a family: their cumulative counts, and the running
    minimum from the largest down, which is carried from partition to partition.
    """
    df = cut(df)
    counts = spread(df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n")), [*by, p])
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_m")).select(*grouped_names(by), "_m")
    rows = carried(counts, [p], "_n", "_before", by).join(F.broadcast(sizes) if not by else sizes, same_group(by)).drop(*(f"_by_{c}" for c in by))
    rows = rows.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.col("_n")))
    inside = F.min("_q").over(Window.partitionBy("_part", *by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.groupBy("_part", *by).agg(F.min("_q").alias("_least"))
    later = F.min("_least").over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))  # one row a partition and group
    parts = parts.select(F.col("_part").alias("_of"), *grouped_names(by), later.alias("_later"))
    rows = rows.withColumn("_inside", inside).join(parts, (F.col("_part") == F.col("_of")) & same_group(by))
    adjusted = rows.select(*(F.col(f"_by_{c}") for c in by), F.col(p).alias("_p"), F.least(F.lit(1.0), "_inside", F.coalesce("_later", F.lit(1.0))).alias(out))
    found = df.join(adjusted, same_group(by) & (F.col(p) == F.col("_p")), "left").drop("_p", *(f"_by_{c}" for c in by))
    return found.withColumn("significant_fdr05", F.coalesce(F.col(out) < 0.05, F.lit(False)))


def exceedance(draws: DataFrame, draw: str, observed: Column) -> Column:
    """Aggregate over draws: (draws at or above observed, plus one) / (draws plus one)."""
    return (F.sum((F.col(draw) >= observed).cast("long")) + 1) / (F.count(draw) + 1.0)


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two binary readings; NULL if chance agreement is certain."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    first = df.filter(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("_a"), F.avg(y).alias("_b"), F.count("*").alias("n"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return first.withColumn("_e", chance).select(*by, F.when(F.col("_e") != 1, (F.col("agreement") - F.col("_e")) / (1 - F.col("_e"))).alias("kappa"), "agreement", "n")


def kappa_permutation(df: DataFrame, a: str, b: str, order: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """kappa() of the whole table with its two-sided p under random orders of the second readings, (count + 1) / (replicates + 1)."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*order, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_a"), F.lit(0.0))).first()
    names = "kappa double, agreement double, n long, p_value double"
    if not n:
        return df.sparkSession.createDataFrame([], names)
    zeros = n - int(ones)
    sums = X.permuted_sums(X.placed_rows(rows, ["_a", *order], ["_b"]), [zeros, n - zeros], replicates, seed)[:, :, 0]
    agreement = (zeros - sums[:, 0] + sums[:, 1]) / n
    x, y = (n - zeros) / n, sums.sum(1) / n
    chance = x * y + (1 - x) * (1 - y)
    values = np.where(chance == 1, np.nan, ratio(agreement - chance, 1 - chance))
    p = _share(np.abs(values[1:]), abs(values[0])) if np.isfinite(values[0]) else None
    return df.sparkSession.createDataFrame([(_number(values[0]), float(agreement[0]), n, p)], names)


def variance_share(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the variance of a value that lies between groups."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n = F.sum("c")
    grand = F.sum(F.col("c") * F.col("m")) / n
    between = F.sum(F.col("c") * F.col("m") * F.col("m")) - n * grand * grand
    return per.groupBy(*by).agg((between / (between + F.sum(F.col("c") * F.col("v")))).alias("share"), n.alias("n"), F.count("*").alias("n_groups"))


def variance_share_reference(df: DataFrame, value: str, group: str, order: Sequence[str], replicates: int, seed: int = 0, least_rows: int = 0, least_groups: int = 0) -> DataFrame:
    """variance_share with its mean under permuted groups and the exceedance p; no row for a table or a number of groups that is too small."""
    rows = df.filter(F.col(value).isNotNull())
    sizes = [r.n for r in rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).limit(MOST_GROUPS + 1).collect()]
    names = "share double, n long, n_groups long, reference_mean double, p_raw double, excess double"
    if not sizes or sum(sizes) < least_rows or len(sizes) < least_groups:
        return df.sparkSession.createDataFrame([], names)
    if len(sizes) > MOST_GROUPS:
        return _variance_share_of_many(rows, value, group, order, replicates, seed)
    squares = rows.agg(F.sum(F.col(value).cast("double") * F.col(value))).first()[0]
    sums, n = X.permuted_sums(X.placed_rows(rows, [group, *order], [value]), sizes, replicates, seed)[:, :, 0], sum(sizes)
    mean = sums.sum(1) ** 2 / n
    values = ratio((sums**2 / np.array(sizes, float)).sum(1) - mean, squares - mean)
    good = values[1:][np.isfinite(values[1:])]
    reference = float(good.mean()) if len(good) else None
    own = _number(values[0])
    return df.sparkSession.createDataFrame([(own, n, len(sizes), reference, None if own is None else _share(good, own), None if own is None or reference is None else own - reference)], names)


def _variance_share_of_many(rows: DataFrame, value: str, group: str, order: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """variance_share_reference() for any number of groups, with a row for each row and replicate."""
    places = numbered(rows, [group, *order]).select("i", group)
    draws = variance_share(permuted(rows, value, [group, *order], replicates, seed).join(places.hint("shuffle_hash"), "i"), value, group, ["b"]).select(F.col("share").alias("draw"))
    observed = variance_share(rows, value, group)
    return draws.crossJoin(F.broadcast(observed)).groupBy("share", "n", "n_groups").agg(F.avg("draw").alias("reference_mean"), exceedance(draws, "draw", F.col("share")).alias("p_raw")).withColumn("excess", F.col("share") - F.col("reference_mean"))  # one row


_MANTEL = "spearman double, n long, p_value double"


def _mantel_row(df: DataFrame, products: np.ndarray, x: np.ndarray, y: np.ndarray) -> DataFrame:
    """The correlation of the table and its p, from sums of products of centred ranks."""
    scale = float(np.sqrt((x @ x) * (y @ y)))
    if not scale:
        return df.sparkSession.createDataFrame([(None, len(x), None)], _MANTEL)
    values = products / scale
    return df.sparkSession.createDataFrame([(float(values[0]), len(x), _share(np.abs(values[1:]), abs(values[0])))], _MANTEL)


def _centred_ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks less their mean."""
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - n + (n + 1) / 2)[code]
    return ranks - ranks.mean() if len(ranks) else ranks


#: Objects whose distances every task holds as a matrix at most; more are permuted by joins.
MOST_OBJECTS = 3000


def mantel(d: DataFrame, a: str, b: str, x: str, y: str, objects: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Spearman correlation of two distances and its p under permutation of the objects of the second.

    d holds every unordered pair once (a before b); objects has one column of them. A permutation of the
    objects of a full triangle leaves the multiset of ranks as it is, so ranks are made once and a replicate is one product of
    two matrices of them. Where pairs are missing or a distance is, entries are permuted instead.
    """
    names = [r[0] for r in objects.distinct().orderBy(objects.columns[0]).limit(MOST_OBJECTS + 1).collect()]
    rows = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if len(names) > MOST_OBJECTS:
        return _mantel_by_joins(d, a, b, x, y, objects, replicates, seed)
    if rows.count() != len(names) * (len(names) - 1) // 2:
        return mantel_entries(d, x, y, [a, b], replicates, seed)
    at = {v: i for i, v in enumerate(names)}
    pairs = rows.select(F.col(a), F.col(b), F.col(x).cast("double"), F.col(y).cast("double")).collect()  # a triangle of at most MOST_OBJECTS objects
    i, j = (np.array([at[r[c]] for r in pairs], int) for c in (0, 1))
    ranks, matrices = [_centred_ranks(np.array([r[c] for r in pairs], float)) for c in (2, 3)], []
    for r in ranks:
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = r
        matrices.append(m)
    return _mantel_row(d, X.permuted_triangles(*matrices, d, replicates, seed), *ranks)


def _mantel_by_joins(d: DataFrame, a: str, b: str, x: str, y: str, objects: DataFrame, replicates: int, seed: int) -> DataFrame:
    """mantel() for any number of objects, with a row for each pair and replicate."""
    name = objects.columns[0]
    ranks = ranked(ranked(cut(d.select(a, b, x, y)), x, "_rx"), y, "_ry")
    numbers = numbered(objects, [name]).select(F.col(name).alias("o"), "i")
    maps = permuted(objects, name, [name], replicates, seed).select("b", "i", F.col(name).alias("to")).withColumnRenamed("b", "rep")
    moved = maps.join(numbers, "i").select("rep", F.col("o").alias("from"), "to")
    pairs = ranks.select(F.col(a).alias("a"), F.col(b).alias("b"), "_rx")
    one = pairs.join(moved.select("rep", F.col("from").alias("a"), F.col("to").alias("ta")), "a").join(moved.select("rep", F.col("from").alias("b"), F.col("to").alias("tb")), ["rep", "b"])
    other = ranks.select(F.col(a).alias("lo"), F.col(b).alias("hi"), "_ry")
    drawn = one.join(other, (F.least("ta", "tb") == F.col("lo")) & (F.greatest("ta", "tb") == F.col("hi")))
    draws = drawn.groupBy("rep").agg(F.corr("_rx", "_ry").alias("draw"))
    observed = ranks.agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))
    return draws.crossJoin(F.broadcast(observed)).groupBy("spearman", "n").agg(((F.sum((F.abs("draw") >= F.abs("spearman")).cast("long")) + 1) / (F.count("*") + 1.0)).alias("p_value"))  # one row


def mantel_entries(d: DataFrame, x: str, y: str, order: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """mantel() for pairs that are no full triangle: the entries of the second distance are permuted, not the objects.

    Ranks are made once and written. Every task holds them all up to X.ENTRIES rows; beyond that a task holds parts of them.
    """
    rows = cut(d.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*order, F.col(x).alias("x"), F.col(y).alias("y")))
    n = rows.count()
    ranks = cut(ranked(ranked(rows, "x", "rx"), "y", "ry").select(*order, *((F.col(c) - (n + 1) / 2.0).alias(c) for c in ("rx", "ry"))))
    places = X.placed_rows(ranks, order, ["rx", "ry"])
    if n > X.ENTRIES:
        xx, yy = ranks.agg(*(F.sum(F.col(c) ** 2) for c in ("rx", "ry"))).first()
        products = X.permuted_rank_products(places, replicates, seed)
    else:
        sums = X.permuted_products(places, [0, 1], [0, 1], replicates, seed)
        xx, yy, products = sums[0, 0, 0], sums[0, 1, 1], sums[:, 0, 1]
    scale = float(np.sqrt(xx * yy))
    if not n or not scale:
        return d.sparkSession.createDataFrame([(None, n, None)], _MANTEL)
    values = products / scale
    return d.sparkSession.createDataFrame([(float(values[0]), n, _share(np.abs(values[1:]), abs(values[0])))], _MANTEL)


def range_reference(wide: DataFrame, row_id: str, group: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """Range of the group means, and its reference when values are shuffled between groups within each row."""
    means = wide.groupBy(group).agg(F.avg(value).alias("m"))
    observed = means.agg((F.max("m") - F.min("m")).alias("observed_range"), F.count("*").alias("n_groups"))
    place = F.row_number().over(Window.partitionBy("b", row_id).orderBy(hash_key(seed, F.col("b"), F.col(row_id), F.col(group)), group))
    drawn = replicated(wide, replicates).withColumn("g", place).groupBy("b", "g").agg(F.avg(value).alias("m")).groupBy("b").agg((F.max("m") - F.min("m")).alias("draw"))
    return drawn.crossJoin(F.broadcast(observed)).groupBy("observed_range", "n_groups").agg(F.avg("draw").alias("reference_mean"), F.percentile("draw", 0.025).alias("reference_ci_low"), F.percentile("draw", 0.975).alias("reference_ci_high"), exceedance(drawn, "draw", F.col("observed_range") * (1 - 1e-9)).alias("p_reference")).withColumn("excess", F.col("observed_range") - F.col("reference_mean"))  # one row


def bracketed(df: DataFrame, point: str, low: str, high: str, slack: float = 1e-9) -> DataFrame:
    """df, failing if an interval does not hold its point."""
    bad = (F.col(point) < F.col(low) - slack) | (F.col(point) > F.col(high) + slack)
    return df.withColumn(point, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("an interval leaves its point out")).cast("double")).otherwise(F.col(point)))


def detectable_effect(error: float, n: int | None = None, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """Smallest effect found with the given power: from a standard error, or from a standard deviation and n."""
    if not error or error <= 0 or (n is not None and n < 2):
        return None
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return z * error / (n**0.5 if n else 1)


def by_replicate(draws: DataFrame, statistic: Callable, schema: str) -> DataFrame:
    """Any statistic of a pandas frame for each replicate b; a replicate must fit into a task."""
    return draws.groupBy("b").applyInPandas(lambda f: statistic(f), schema)


def gap_reference(overall: float, counts: Sequence[tuple[int, int]], draws: int = REPLICATES, seed: int = 0) -> dict[str, float | int | None]:
    """Range that subgroup AUROCs of equal truth would show, by the variance for their class counts.

    counts are few pairs of positives and negatives; a driver-side simulation over them.
    """
    usable = [(p, q) for p, q in counts if p > 0 and q > 0]
    if len(usable) < 2 or overall != overall:
        return {"reference_mean": None, "reference_std": None, "reference_ci_low": None, "reference_ci_high": None, "n_subgroups": len(usable)}
    a = min(max(overall, 1e-6), 1 - 1e-6)
    p, q = np.array(usable, float).T
    both, one = a / (2 - a) - a * a, 2 * a * a / (1 + a) - a * a
    sd = np.sqrt(np.maximum((a * (1 - a) + (p - 1) * both + (q - 1) * one) / (p * q), 1e-12))
    ranges = np.ptp(np.random.default_rng(seed).normal(a, sd, (draws, len(sd))), axis=1)
    low, high = np.percentile(ranges, [2.5, 97.5])
    return {"reference_mean": float(ranges.mean()), "reference_std": float(ranges.std(ddof=1)), "reference_ci_low": float(low), "reference_ci_high": float(high), "n_subgroups": len(usable)}


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        out = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / (d or tiny), c or tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation or rank correlation of n pairs."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else student_p(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)


def paired_gain(df: DataFrame, before: str, after: str, least_gain: float = 0.01, alpha: float = 0.05) -> dict[str, float | bool | None]:
    """Paired t-test of a gain: passed if p is below alpha and the mean gain above a share of the baseline."""
    r = df.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).agg(F.avg(F.col(after) - F.col(before)).alias("gain"), F.stddev_samp(F.col(after) - F.col(before)).alias("sd"), F.avg(before).alias("base"), F.count("*").alias("n")).first()
    if r.n < 2 or r.sd is None:
        return {"gain": r.gain, "p_value": None, "passed": False}
    p = student_p(r.gain / (r.sd / r.n**0.5), r.n - 1) if r.sd > 0 else (0.0 if r.gain else 1.0)
    return {"gain": r.gain, "p_value": p, "passed": bool(p < alpha and r.gain > least_gain * abs(r.base))}


def contrast(pairs: DataFrame, a: str, b: str, value: str, group: str, first: str, second: str) -> DataFrame:
    """Difference of the mean pair values of two groups, with a jackknife over units."""
    rows = pairs.filter(F.col(group).isin(first, second))
    difference = F.avg(F.when(F.col(group) == first, F.col(value))) - F.avg(F.when(F.col(group) == second, F.col(value)))
    return jackknife_units(rows, a, b, difference)


def reported(df: DataFrame, prefix: str, share: bool = True) -> DataFrame:
    """Statistics under the names of reports: prefix_mean and the like, in percent if they are shares, with raw twins."""
    names = {"point": "mean", "std": "std", "ci_low": "ci_low", "ci_high": "ci_high"}
    shown = lambda c: F.round(F.col(c) * (100.0 if share else 1.0), 1)
    cols = [x for c, n in names.items() if c in df.columns for x in (shown(c).alias(f"{prefix}_{n}"), F.col(c).alias(f"{prefix}_{n}_raw"))]
    return df.select(*(F.col(c) for c in df.columns if c not in names), *cols)


def grouped_means(df: DataFrame, value: str, by: Sequence[str], replicates: int = REPLICATES, seed: int = 0, tested: bool = False) -> DataFrame:
    """(by..., point, n, std, ci_low, ci_high) of the mean of each group, and with `tested` p_value as paired_bootstrap() has it; values that are absent do not count.

    The different values of a large group, with their numbers of rows, are cut into parts at quantiles; a task goes through all draws of its group and adds up those that fall into
    its part, so no task holds a group. A replicate's draws are those that bootstrap_mean() of the group alone would make if it were one cell, whatever the number of its rows.
    """
    kinds = dict(df.dtypes)
    keys = [f"`{c}` {kinds[c]}" for c in by]
    schema = ", ".join([*keys, "point double, n long, std double, ci_low double, ci_high double, p_value double"])
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    values = cut(rows.groupBy(*by, "_value").agg(F.count("*").alias("_n")))
    weights = values.groupBy(*by).agg(F.sum(1 + F.floor(F.col("_n") / PART_COPIES)).alias("_weight"))
    most = -(-(weights.agg(F.max("_weight")).first()[0] or 0) // PART_VALUES)
    piece = F.lit(0)
    placed = values
    if most > 1:  # large groups alone, few by their size, are cut at quantiles of their values
        borders = values.groupBy(*by).agg(F.sum(1 + F.floor(F.col("_n") / PART_COPIES)).alias("_weight"), F.percentile_approx("_value", [k / most for k in range(1, most)]).alias("_borders")).filter(F.col("_weight") > PART_VALUES)
        placed = values.join(F.broadcast(borders.select(*grouped_names(by), "_borders", F.ceil(F.col("_weight") / PART_VALUES).alias("_parts"))), same_group(by), "left")
        below = sum((F.col("_borders")[k] < F.col("_value")).cast("int") for k in range(most - 1))
        piece = F.coalesce(F.floor(below * F.col("_parts") / most), F.lit(0))
    placed = placed.select(*by, piece.cast("int").alias("_piece"), "_value", "_n")
    own = Window.partitionBy(*by)
    sizes = placed.groupBy(*by, "_piece").agg(F.sum("_n").alias("_rows"))  # a row for each part of a group
    sizes = sizes.withColumn("_low", F.sum("_rows").over(own.orderBy("_piece")) - F.col("_rows")).withColumn("_total", F.sum("_rows").over(own))
    sizes = cut(sizes.select(*grouped_names(by), F.col("_piece").alias("_of"), "_low", "_total"))
    dealt = placed.join(sizes, (F.col("_piece") == F.col("_of")) & same_group(by)).select(*by, "_piece", "_low", "_total", "_value", "_n")

    def draw(table: pa.Table) -> pa.Table:
        x, n = (table.column(c).to_numpy() for c in ("_value", "_n"))
        order = np.argsort(x, kind="stable")
        x, n = x[order], n[order]
        low, total = (table.column(c)[0].as_py() for c in ("_low", "_total"))
        sums = X.drawn_sums(x, n, low, total, replicates, seed)
        return pa.table([*(table.column(c).slice(0, 1) for c in by), pa.array([total], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=[*by, "total", "data"])

    def of(table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        means = np.sum([np.frombuffer(d.as_buffer()) for d in table.column("data")], axis=0) / total
        point, draws = float(means[0]), means[1:]
        std, low, high, _ = spread_of(draws)
        p = max(float(X.at_least(np.abs(draws - point), abs(point)).mean()), 1.0 / replicates)
        told = [pa.array([v], pa.float64()) for v in (point, std, low, high, p)]
        return pa.table([*(table.column(c).slice(0, 1) for c in by), told[0], pa.array([total], pa.int64()), *told[1:]], names=[*by, "point", "n", "std", "ci_low", "ci_high", "p_value"])

    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # what a task does grows with draws, not with bytes
    parts = dealt.repartition(tasks, *by, "_piece").groupBy(*by, "_piece").applyInArrow(draw, ", ".join([*keys, "total long, data binary"]))
    out = parts.groupBy(*by).applyInArrow(of, schema)
    return out if tested else out.drop("p_value")
