"""Deterministic samples and splits, in the order of a hash of the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.order import carried, spread
from concord.sources.shared import cut


def hash_key(seed: int | str, *ids: Column) -> Column:
    """The key by which samples are ordered: MD5 of the seed and the ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def hash_number(seed: int | str, *ids: Column) -> Column:
    """The first 60 bits of hash_key as a number."""
    return F.conv(F.substring(hash_key(seed, *ids), 1, 15), 16, 10).cast("long")


def _rank(by: Sequence[str], seed: int | str, id_col: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(seed, F.col(id_col)), id_col))


def hash_ranked(df: DataFrame, by: Sequence[str], seed: int | str, id_col: str) -> DataFrame:
    """df with `_rank`: the place of each row of a group in hash order, from 1, for groups of any size.

    A group is sorted in the pieces that the first four digits of the hash make; the rows before
    each piece come from counts.
    """
    keyed = df.withColumn("_key", hash_key(seed, F.col(id_col))).withColumn("_digits", F.substring("_key", 1, 4))
    counts = keyed.groupBy(*by, "_digits").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_digits").alias("_of"), before.alias("_before"))
    same = F.col("_digits") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_digits").orderBy("_key", id_col))
    return keyed.join(placed, same).withColumn("_rank", F.col("_before") + inside).drop("_key", "_digits", "_of", "_before", *(f"_by_{c}" for c in by))


def cap_per_group(df: DataFrame, group: str, cap: int, seed: int, id_col: str) -> DataFrame:
    """At most cap rows of each group; all if cap is not positive."""
    return df if cap <= 0 else df.withColumn("_rank", _rank([group], seed, id_col)).filter(F.col("_rank") <= cap).drop("_rank")


def capped(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows of the table, or all if it has no more."""
    return df.orderBy(hash_key(seed, F.col(id_col)), id_col).limit(n)


def capped_draws(df: DataFrame, n: int, draws: int, seed: int | str, id_col: str) -> DataFrame:
    """(i, id_col): what capped() takes with the seeds seed:0, seed:1 and so on, all draws in one scan.

    Only rows whose hash is so small that about twice as many as are wanted reach it are sorted; a draw with too few of
    them is made from a wider part, in the end from all rows.
    """
    ids, total, width = df.select(id_col), df.count(), 2 * n + 64
    every = df.sparkSession.range(draws).select(F.col("id").cast("int").alias("i"))
    todo, out = every, None
    while True:
        key = F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), F.col(id_col).cast("string")))
        keyed = ids.crossJoin(F.broadcast(todo)).withColumn("_key", key)  # a number for each draw
        if width < total:
            keyed = keyed.filter(F.col("_key") < f"{int(width / total * (1 << 60)):015x}")
        place = F.row_number().over(Window.partitionBy("i").orderBy("_key", id_col))
        found = cut(keyed.withColumn("_rank", place).filter(F.col("_rank") <= n).select("i", id_col))
        full = cut(found.groupBy("i").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min(n, total)).select("i"))
        part = found.join(full, "i", "left_semi")
        out = part if out is None else out.unionByName(part)
        todo = cut(todo.join(full, "i", "left_anti"))
        if width >= total or todo.isEmpty():
            return out
        width *= 8


def head(df: DataFrame, n: int, id_col: str) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def balanced(df: DataFrame, label: str, n: int, seed: int, id_col: str) -> DataFrame:
    """As many rows of label 1 as of label 0: n of each, or as many as the rarer has."""
    counts = df.filter(F.col(label).isin(0, 1)).groupBy(label).count()
    least = counts.agg(F.when(F.count("*") == 2, F.min("count")).otherwise(0).alias("_least"))
    ranked = df.filter(F.col(label).isin(0, 1)).withColumn("_rank", _rank([label], seed, id_col)).filter(F.col("_rank") <= n)
    return ranked.crossJoin(F.broadcast(least)).filter(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")  # one row


def matched_draw(df: DataFrame, group: str, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows of every group that has so many; none of the others."""
    large = df.filter(F.col(group).isNotNull()).groupBy(group).count().filter(F.col("count") >= n).select(group)
    return df.withColumn("_rank", _rank([group], seed, id_col)).filter(F.col("_rank") <= n).drop("_rank").join(large, group, "left_semi")


def subgroup_draws(df: DataFrame, attributes: Sequence[str], seed: int, id_col: str, low: int = 2, high: int = 20) -> DataFrame:
    """(attribute, level, id): draws of equal size from every level of each attribute of low to high levels."""
    levels = df.select(id_col, F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.trim(F.col(a).cast("string")).alias("level")) for a in attributes))).alias("x"))
    levels = levels.select(id_col, "x.*").filter(F.coalesce(F.col("level"), F.lit("")) != "")
    sizes = levels.groupBy("attribute", "level").count()
    usable = sizes.groupBy("attribute").agg(F.count("*").alias("n_levels"), F.min("count").alias("least")).filter(F.col("n_levels").between(low, high))
    ranked = hash_ranked(levels, ["attribute", "level"], seed, id_col).join(usable, "attribute")
    return ranked.filter(F.col("_rank") <= F.col("least")).select("attribute", "level", id_col)


def take_until(df: DataFrame, unit: str, cap: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of whole units, added in hash order until there are cap rows or more."""
    sizes = df.groupBy(*by, unit).agg(F.count("*").alias("_n")).withColumn("_key", hash_key(seed, F.col(unit)))
    order = ["_key", unit]
    chosen = carried(spread(sizes, [*by, *order]), order, "_n", "_before", by).filter(F.col("_before") < cap)
    return df.join(chosen.select(*by, unit), [*by, unit], "left_semi")


def take_fitting(df: DataFrame, unit: str, cap: int, seed: int, by: str) -> DataFrame:
    """Rows of whole units in hash order, each taken unless it would pass the cap of its group.

    In rounds, for all groups at once: the units before the first that does not fit are taken by their running sum, those
    larger than what is then left can never be, and the rest go on from there. A round takes
    prefix sums over range partitions, so no group meets in one task.
    """
    sizes = df.groupBy(by, unit).agg(F.count("*").alias("_n")).withColumn("_key", hash_key(seed, F.col(unit)))
    rows, taken, order = cut(sizes.filter(F.col("_n") <= cap).withColumn("_left", F.lit(cap).cast("long"))), None, ["_key", unit]
    while not rows.isEmpty():
        placed = cut(carried(spread(rows, [by, *order]), order, "_n", "_before", [by]).drop("_part"))
        fits = F.col("_before") + F.col("_n") <= F.col("_left")
        own = placed.filter(fits)
        taken = own.select(by, unit) if taken is None else taken.unionByName(own.select(by, unit))
        spent = own.groupBy(F.col(by).alias("_of")).agg(F.sum("_n").alias("_spent"))
        left = F.col("_left") - F.coalesce("_spent", F.lit(0))
        rows = placed.filter(~fits).join(spent, F.col(by).eqNullSafe(F.col("_of")), "left").withColumn("_left", left)
        rows = cut(rows.filter("_n <= _left").select(by, unit, "_n", "_key", "_left"))
    return df.join(taken, [by, unit], "left_semi") if taken is not None else df.limit(0)


def unit_split(df: DataFrame, unit: str, seed: int, share: float = 0.7) -> DataFrame:
    """df with `part`: train for the first share of the units in hash order (at least one), test for the rest.

    The last key of the first share is found by counts of the keys' first four digits and a sort of
    the few units that share them, not by a sort or a window over all units.
    """
    units = df.select(unit).distinct().withColumn("_key", hash_key(seed, F.col(unit)))
    per = sorted((r.d, r.n) for r in units.groupBy(F.substring("_key", 1, 4).alias("d")).agg(F.count("*").alias("n")).collect())
    left, digits = max(1, int(share * sum(n for _, n in per))), ""
    for digits, n in per:
        if left <= n:
            break
        left -= n
    last = units.filter(F.substring("_key", 1, 4) == digits).orderBy("_key").limit(left).agg(F.max("_key")).first()[0]
    return df.withColumn("part", F.when(hash_key(seed, F.col(unit)) <= F.lit(last), "train").otherwise("test"))


def matched_sides(df: DataFrame, side: str, grade: str, seed: int, id_col: str) -> DataFrame:
    """As many rows of one side as of the other within each grade."""
    ranked = hash_ranked(df.filter(F.col(side).isNotNull() & F.col(grade).isNotNull()), [grade, side], seed, id_col)
    sizes = ranked.groupBy(grade, side).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(grade).agg(F.when(F.count("*") == 2, F.min("_n")).otherwise(0).alias("_least"))
    return ranked.join(least, grade).filter(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")


def anchors(df: DataFrame, findings: Sequence[str], n: int, seed: int, id_col: str) -> DataFrame:
    """(id, pos): up to n // findings positives of each finding, each case once, then other cases up to n."""
    share = max(1, n // max(1, len(findings)))
    marked = df.select(id_col, F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("y")) for i, c in enumerate(findings)))).alias("x")).select(id_col, "x.*").filter("y = 1")
    picked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("f").orderBy(hash_key(seed, F.col(id_col)), id_col))).filter(F.col("_rank") <= share)
    picked = picked.groupBy(id_col).agg(F.min(F.struct("f", "_rank")).alias("place"))
    rest = df.select(id_col).distinct().join(picked, id_col, "left_anti").orderBy(hash_key(seed, F.col(id_col)), id_col).limit(n)
    both = picked.select(id_col, "place.f", F.col("place._rank").alias("r")).unionByName(rest.select(id_col, F.lit(len(findings)).alias("f"), F.row_number().over(Window.orderBy(hash_key(seed, F.col(id_col)), id_col)).alias("r")))
    chosen = both.orderBy("f", "r").limit(n)  # at most n rows, so one window places them
    return chosen.select(id_col, (F.row_number().over(Window.orderBy("f", "r")) - 1).alias("pos"))
