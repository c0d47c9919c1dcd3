"""Column functions on keys, paths, lists in cells and hierarchical codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """Last step of a path without what follows its last dot."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def case_id(site: Column, key: Column) -> Column:
    """Case id by the key conventions of a site: site and what names the image, joined by two underscores."""
    k = F.trim(key)
    flat = F.regexp_replace(F.replace(F.replace(k, F.lit("CheXpert-v1.0/"), F.lit("")), F.lit("/"), F.lit("_")), r"(?i)\.jpg$", "")
    base = (
        F.when(site == "mimic", F.replace(F.substring_index(k, "/", -1), F.lit(".jpg"), F.lit("")))
        .when(site == "chexpert", flat)
        .when(site == "nih_cxr14", stem(k))
        .when(site == "padchest", F.regexp_replace(k, r"\.[^.]*$", ""))
        .otherwise(k)
    )
    return F.concat(site, F.lit("__"), base)


def integral_text(value: Column) -> Column:
    """'1.0' as '1' where the text is a whole number; other texts as they are."""
    x = value.try_cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(value)


def image_path(dataset: Column, root: Column, key: Column, split: Column, subdir: Column, small: bool = True) -> Column:
    """Where the image of a key lies, by the layout of its dataset; NULL for an unknown one."""
    folder = "preprocessed224" if small else "preprocessed"
    part = F.when(split == "test", "test").otherwise("train")
    named = F.when(key.endswith(".jpg"), key).otherwise(F.concat(key, F.lit(".jpg")))
    sub = F.when(F.coalesce(subdir, F.lit("")).isin("", "nan", "None"), None).otherwise(integral_text(subdir))
    join = lambda *c: F.concat_ws("/", *c)
    return (
        F.when(dataset == "mimic", join(root, F.replace(key, F.lit("files/"), F.lit(f"{folder}/"))))
        .when(dataset == "chexpert", join(root, F.regexp_replace(key, "^CheXpert-v1.0/", f"CheXpert-v1.0/{folder}/")))
        .when(dataset == "nih_cxr14", join(root, F.lit("CXR14"), F.lit(folder), key))
        .when(dataset == "padchest", join(root, F.lit(folder), sub, key))
        .when(dataset.isin("vindr_cxr", "vindr_pcxr"), join(root, F.lit(folder), part, named))
        .when(dataset == "taix", join(root if small else F.replace(root, F.lit("preprocessed224"), F.lit("preprocessed")), key))
        .when(dataset == "rexgradient", join(root, F.regexp_replace(key, r"^(\.\./)+", "")))
    )


def rerooted(path: Column, marker: str, root: str) -> Column:
    """The path from the marker on below another root; unchanged without the marker."""
    at = F.instr(path, marker)
    return F.when(at > 0, F.concat(F.lit(f"{root}/"), F.substr(path, at))).otherwise(path)


def combined_sections(*sections: Column, fallback: Column | None = None) -> Column:
    """Non-blank sections joined by line breaks, else the fallback text, else empty."""
    cleaned = [F.when(F.trim(s) != "", F.trim(s)) for s in sections]
    joined = F.concat_ws("\n", *cleaned)
    other = F.coalesce(F.trim(fallback), F.lit("")) if fallback is not None else F.lit("")
    return F.when(joined != "", joined).otherwise(other)


def listed(cell: Column) -> Column:
    """The items of a list written in a cell with quotes and brackets."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0)), lambda x: F.trim(F.substr(x, F.lit(2), F.length(x) - 2)))


def vendor(cell: Column) -> Column:
    """A plain name, the only item of a list, or `mixed: a + b` for several, in order."""
    t = F.trim(cell)
    items = listed(t)
    return F.when(t.startswith("[") & t.endswith("]"), F.when(F.size(items) == 1, items[0]).otherwise(F.concat(F.lit("mixed: "), F.array_join(F.array_sort(items), " + ")))).otherwise(t)


def normal_code(code: Column) -> Column:
    """A hierarchical code in capitals, without dots and outer spaces."""
    return F.upper(F.trim(F.replace(code, F.lit("."), F.lit(""))))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    steps = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(steps, lambda i: F.left(a, i) == F.left(b, i)))


def code_distance(a: Column, b: Column) -> Column:
    """Steps between two codes in the tree that their prefixes form."""
    p = shared_prefix(a, b)
    return F.length(a) + F.length(b) - 2 * p


def taxonomy_distance(a: Column, b: Column, group_a: Column, group_b: Column) -> Column:
    """0 for the same class, 1 for the same group, else 2; two classes without a group count as one group."""
    return F.when(a == b, 0).when(group_a.eqNullSafe(group_b), 1).otherwise(2)


def key_parts(key: Column, names: Sequence[str]) -> list[Column]:
    """The parts of a key joined by two underscores, under their names; missing parts are NULL."""
    parts = F.split(key, "__")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(a, b), F.greatest(a, b)


def joined_distinct(value: Column) -> Column:
    """Aggregate: the distinct values in order, joined by semicolons."""
    return F.concat_ws(";", F.array_sort(F.collect_set(value)))
