"""Vector codes: filtered trees against plain nearest entries, and the result against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import vectorcodes
from concord.llm.kdtree import PartTree

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", [np.float64, object])
@pytest.mark.parametrize("spread", [0, 1, 40])
def test_trees_assign_as_plain_comparison_does(kind, spread):
    r = np.random.default_rng(spread)
    centres = r.integers(-50, 50, (12, 5))
    points = (centres[r.integers(0, 12, 700)] + r.integers(-spread, spread + 1, (700, 5))).astype(kind)
    entries = np.concatenate([points[:20], points[:3], points[5:9] + 1])  # entries that repeat, and ties
    tree = PartTree(points, leaf=8)
    codes, counts, sums, whole = tree.assign(entries)
    away = ((points[:, None] - entries[None]) ** 2).sum(2)
    want = away.astype(np.float64).argmin(1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
    assert (sums == np.array([points[want == k].sum(0) if (want == k).any() else np.zeros(5) for k in range(len(entries))])).all()
    assert (tree.original() == points).all() and (spread or whole > 600)


def plain(rows, parts, entries, rounds, scale):
    """Every step in Python's integers."""
    kept = [(i, [math.floor(x * scale) for x in np.float32(v).astype(float).tolist()], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // parts
    part = lambda v, k: v[k * w : k * w + w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, k) for _, v, _ in first] for k in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda k, v: min((away(part(v, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(k, v)[1], []).append(part(v, k))
            new.append([[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])])
        books = new
    found = [(i, [nearest(k, v) for k in range(parts)], lab) for i, v, lab in kept]
    by = {}
    for _, n, lab in found:
        by[lab] = by.get(lab, 0) + sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), by[lab], sha) for i, n, lab in found), key=repr)


def vectors(case, n=90, width=8):
    r = random.Random(case)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 9]], None if i % 11 == 0 else i % 4) for i in range(n)]
    rows += [(500 + i, centres[0], 1) for i in range(40)]  # one vector many times
    rows += [(3, centres[1], 2), (3, centres[1], 2), (None, centres[2], 3), (900, None, 1), (901, [None] * width, 1), (902, [math.nan] * width, 1), (903, [math.inf] * width, 1)]
    if case == "short":
        rows += [(910, [], 1), (911, [0.5], 2), (912, [0.25] * (width + 1), 0)]
    if case == "wide":
        rows += [(-5, [3.0e9] * width, 1), (913, [3.0e9 + 4096] * width, 1), (914, [-2.0e6] * width, 0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("case, parts, entries, rounds", [("plain", 4, 16, 4), ("short", 4, 256, 4), ("wide", 2, 12, 2), ("one", 1, 1, 1)])
def test_against_plain_rounds(spark, monkeypatch, case, parts, entries, rounds):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 32)
    rows = vectors(case)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("ids", "labels", "trees", "code", "error", "_label", "label_error")})
    found = vectorcodes.compress(df.repartition(3), parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, parts, entries, rounds, 1024)


def test_many_labels_and_other_types(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "FEW_LABELS", 2)
    rows = vectors("plain")
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.concat(F.lit("l"), "label").alias("kind"))
    found = vectorcodes.compress(df, "id", "v", "kind", entries=16)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 4, 16, 4, 1024)


def test_no_usable_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [math.nan], None)]):
        found = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
        assert found.count() == 0 and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
