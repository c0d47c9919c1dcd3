"""Column functions that decode labels, answers and subject attributes. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import listed

# Answers that count as yes or no, and code policies by site family.
YES = ("yes", "y", "1", "true")
NO = ("no", "n", "0", "false")
POLICIES = {
    "uncertain": {"positive": 1, "negatives": (0, 2), "excludes": (3,)},
    "binary": {"positive": 1, "negatives": (0,), "excludes": ()},
}
AGE_BANDS = ((0, 40, "<40"), (40, 60, "40-60"), (60, 80, "60-80"), (80, 200, "80+"))
MISSING_WORDS = ("", "nan", "none")


def number(value: Column) -> Column:
    """The value as DOUBLE; NULL where it is no finite number."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def present(value: Column) -> Column:
    """NULL for blank strings and the words that stand for a missing value."""
    return F.when(F.lower(F.trim(value)).isin(*MISSING_WORDS), None).otherwise(value)


def decode_codes(value: Column, positive: float, negatives: Sequence[float]) -> Column:
    """1 for the positive code, 0 for a negative one, else NULL. Codes are compared as they are, without rounding."""
    x = number(value)
    return F.when(x == float(positive), 1.0).when(x.isin(*map(float, negatives)), 0.0)


def decode_presence(value: Column, positive: int = 1, negatives: Sequence[int] = (0,), excludes: Sequence[int] = ()) -> Column:
    """As decode_codes after rounding half to even; an excluded code is NULL whatever the negatives say."""
    x = F.bround(number(value)).cast("long")
    positive_first = F.when(x == positive, 1.0)
    if excludes:
        positive_first = positive_first.when(x.isin(*excludes), F.lit(None).cast("double"))
    return positive_first.when(x.isin(*negatives), 0.0)


def merge_findings(*columns: Column) -> Column:
    """Largest non-NULL label of several native columns; NULL if all are."""
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def age_band(age: Column) -> Column:
    """Band of an age; bands include their upper edge and leave out their lower one."""
    x, out = number(age), None
    for low, high, name in AGE_BANDS:
        inside = (x > low) & (x <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def at_least(value: Column, threshold: float) -> Column:
    """1 or 0, a missing value counting as 0."""
    return F.coalesce((number(value) >= threshold).cast("double"), F.lit(0.0))


def yes_no(answer: Column) -> Column:
    """1 for yes, 0 for no, -1 for anything else."""
    t = F.lower(F.trim(answer.cast("string")))
    return F.when(t.isin(*YES), 1).when(t.isin(*NO), 0).otherwise(-1)


def image_quality(answer: Column) -> Column:
    """The quality that an answer begins to name; other answers as they are, NULL as empty."""
    text = F.trim(answer.cast("string"))
    t = F.lower(text)
    return F.coalesce(F.when(t.startswith("adeq"), "adequate").when(t.startswith("subopt"), "suboptimal").when(t.startswith("non"), "non-diagnostic").otherwise(text), F.lit(""))


def split_name(split: Column) -> Column:
    """Lower case, with val as valid."""
    t = F.lower(split)
    return F.when(t == "val", "valid").otherwise(t)


def sex_code(sex: Column) -> Column:
    """F or M for the full words; other values as they are."""
    return F.when(sex == "Female", "F").when(sex == "Male", "M").otherwise(sex)


def severity(grade: Column) -> Column:
    """1 from grade 2 on, 0 at grade 1, else NULL."""
    g = number(grade)
    return F.when(g >= 2, 1.0).when(g == 1, 0.0)


def laterality(right: Column, left: Column) -> Column:
    """1 if only the right side is affected, 0 if only the left, else NULL."""
    return F.when((right == 1) & (left == 0), 1.0).when((left == 1) & (right == 0), 0.0)


def column_named_by(name: Column, columns: dict[str, Column]) -> Column:
    """The value of the column that another column names; NULL if there is none of that name."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), c.cast("double"))]
    return F.try_element_at(F.create_map(*pairs), name)


def argmax_class(values: Sequence[Column], names: Sequence[str]) -> Column:
    """Name of the largest value, the first of equals; NULLs are skipped."""
    vector = F.array(*values)
    return F.try_element_at(F.array(*map(F.lit, names)), F.array_position(vector, F.array_max(vector)).cast("int"))


def decode_by_policy(long: DataFrame, policies: DataFrame) -> DataFrame:
    """(case_id, finding, vocabulary, value) from native codes (case_id, site, native, code).

    policies is the dimension table (site, native, finding, vocabulary, positive, negatives); several
    native columns of one finding give their largest label. A native column without a policy drops out.
    """
    joined = long.join(policies, ["site", "native"])
    code = number(joined["code"])
    value = F.when(code == F.col("positive"), 1.0).when(F.exists("negatives", lambda x: x == code), 0.0)
    return joined.withColumn("value", value).groupBy("case_id", "finding", "vocabulary").agg(F.max("value").alias("value"))


def subject_columns(sex: Column, age: Column, position: Column, view: Column, zero_is_missing: bool = False) -> list[Column]:
    """Normalised sex, age and view: coded sex, no age of zero where it means missing, the position else the view."""
    a = number(age)
    return [sex_code(sex).alias("sex"), (F.when(a != 0, a) if zero_is_missing else a).alias("age"), F.coalesce(present(position), present(view)).alias("view")]


def has_category(cell: Column, category: str) -> Column:
    """1 or 0: whether the list written in a cell holds a category; NULL for a NULL cell."""
    return F.array_contains(listed(cell), category).cast("double")


def only_category(cell: Column, category: str) -> Column:
    """1 or 0: whether the category is the list's only item."""
    return (listed(cell) == F.array(F.lit(category))).cast("double")
