"""Hard negatives against brute force, and what a scan of rings promises."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import hardnegatives, rings

SCHEMA = "vec_id long, embedding array<float>, label string"
CLASH = ("id", "anchor", "pivot", "away", "block", "low", "high", "set", "at", "slot", "score", "rank", "ids", "labels", "data", "threshold", "more", "positive_id")


def brute(rows, k=5, m=3, least=50, most=95, scale=256, anchor=lambda i: i % 5 == 0):
    kept = [(i, [math.floor(x * scale) for x in np.float32(v).astype(float).tolist()], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, lab in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, v, other in kept if j != i)
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            near = [x for x in scored if x[2] != lab and -least * s <= -100 * x[0] <= -most * s][:m]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)]
    return Counter(out)


def vectors(case, n=240, width=6):
    r = random.Random(case)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    near = {"uniform": 3.0, "signs": 3.0}.get(case, 0.2)
    rows = [(i, [c + r.gauss(0, near) for c in centres[i % 8]], f"l{i % 3}") for i in range(n)]
    rows += [(1000 + i, centres[2], f"l{i % 2}") for i in range(80)]  # a third of all vectors are one
    rows += [(10, centres[1], "l0"), (11, centres[1], "l1"), (11, centres[1], "l1"), (None, centres[0], "l0"), (2000, centres[0], None), (2005, None, "l0"), (2010, [math.nan] * width, "l1"), (2015, [None, *centres[0][1:]], "l1"), (2020, centres[3], "alone"), (2025, [0.0] * width, "l1")]
    if case == "short":
        rows += [(3000, [], "l0"), (3005, [1.0], "l1"), (3010, [0.5] * (width + 2), "l2")]
    if case == "wide":
        rows += [(4000 + 5 * i, [3.0e6 + i] * width, f"l{i % 3}") for i in range(9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("case", ["clusters", "uniform", "short", "wide"])
def test_against_brute_force(spark, monkeypatch, case):
    for name, value in (("BLOCK_ROWS", 24), ("SET_ROWS", 10), ("ROWS_A_PIVOT", 40)):
        monkeypatch.setattr(rings, name, value)
    rows = vectors(case)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
    found = hardnegatives.mine(df.repartition(3), F.col("vec_id") % 5 == 0)
    want = brute(rows)
    assert Counter(map(tuple, found.collect())) == want and len(want) > 300


def test_few_rows_and_few_blocks_known(spark, monkeypatch):
    monkeypatch.setattr(rings, "FEW_BLOCKS", 0)
    rows = [(0, [1.0, 0.0], "a"), (1, [0.9, 0.0], "a"), (2, [0.5, 0.0], "b"), (3, [-1.0, 0.0], "a"), (4, [0.8, 0.1], "b")]
    found = hardnegatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, positives=5, negatives=1)
    assert Counter(map(tuple, found.collect())) == brute(rows, m=1, anchor=lambda i: i == 0)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], "a"), (2, None, "b")], [(5, None, "a"), (None, [1.0], "a")]])
def test_nothing_to_mine(spark, rows):
    found = hardnegatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert found.count() == 0 and [f.name for f in found.schema] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_rings_pass_over_blocks_and_miss_no_row(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 20), ("SET_ROWS", 4), ("ROWS_A_PIVOT", 30)):
        monkeypatch.setattr(rings, name, value)
    rows = [r for r in vectors("clusters", 800, 3) if r[0] is not None and r[0] < 800 and r[0] not in (10, 11)]
    index = rings.build(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)
    seen = []
    sets = [(r.set, i, int(x)) for r in index.sets.collect() for i, x in enumerate(np.frombuffer(r.ids, "<i8"))]
    ints = {i: [math.floor(x * 256) for x in np.float32(v).astype(float).tolist()] for i, v, _ in rows}
    scores = {(a, j): sum(x * y for x, y in zip(ints[a], v)) for _, _, a in sets for j, v in ints.items()}
    least = {a: sorted(s for (b, _), s in scores.items() if b == a)[-5] for _, _, a in sets}
    wanted = spark.createDataFrame([(s, i, float(least[a]), []) for s, i, a in sets], "set long, at int, threshold double, more array<long>")
    hits = rings.scan(index, wanted, lambda scores, same, own, more: [np.nonzero(np.ones(scores.shape, bool))]).collect()
    name = {(s, i): a for s, i, a in sets}
    seen = {(name[r.set, r.at], r.id): r.score for r in hits}
    assert all(scores[k] == s for k, s in seen.items()) and {k for k, s in scores.items() if s >= least[k[0]]} <= set(seen)
    assert len(seen) < 0.7 * len(scores)
