"""Draws on one product, greedy packing in rounds, triplets by strata, arms."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.plans import pipelines as C

SCHEMA = "encoder string, case_id long, embedding array<double>"


def test_draws_equal_a_graph_for_each(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VALUES", 120)
    r = np.random.default_rng(3)
    rows = [(e, i, r.integers(-2, 3, 4).astype(float).tolist()) for e in "ab" for i in range(90)] + [("a", 200, None), ("a", 201, [float("nan")] * 4), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = [(i, f"d{d}") for d in range(5) for i in r.choice(90, 25, replace=False).tolist()] + [(200, "d0"), (201, "d1"), (7, None), (None, "d2"), (999, "d2"), (3, "alone"), (4, "d9"), (4, "d9"), (5, "d9")]
    table = spark.createDataFrame(drawn, "case_id long, draw string")
    got = {(x.draw, x.encoder, x.src, x.dst, x["rank"]) for x in V.knn_edges_of_draws(df, table, 3, rows=20).collect()}
    want = set()
    for d in {n for _, n in drawn if n}:
        own = df.join(table.filter(table.draw == d).select("case_id").distinct(), "case_id", "left_semi").select("encoder", "case_id", "embedding")
        want |= {(d, x.encoder, x.src, x.dst, x["rank"]) for x in V.knn_edges(own, 3).collect()}
    assert got == want and any(x[0] == "d9" for x in got)
    assert V.knn_edges_of_draws(df, table.limit(0), 3).count() == 0
    monkeypatch.setattr(V, "MOST_DRAWS", 3)
    with pytest.raises(ValueError):
        V.knn_edges_of_draws(df, table, 3)


@pytest.mark.parametrize("case", range(4))
def test_greedy_rounds_equal_one_unit_after_another(spark, case):
    r = random.Random(case)
    most, cap = [(6, 40), (40, 40), (3, 1000), (60, 25)][case]
    units = {(g, f"u{i}"): r.randint(1, most) for g in ("x", "y", None) for i in range(40)}
    rows = [(g, u, k) for (g, u), n in units.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, u string, k int").repartition(3)
    got = {(x.g, x.u) for x in S.take_fitting(df, "u", cap, 7, "g").collect()}
    want = set()
    for g in ("x", "y"):
        taken = 0
        for u in sorted((u for h, u in units if h == g), key=lambda u: (hashlib.md5(f"7|{u}".encode()).hexdigest(), u)):
            if taken < cap and taken + units[g, u] <= cap:
                taken += units[g, u]
                want.add((g, u))
    assert {x for x in got if x[0]} == want
    assert S.take_fitting(df.limit(0), "u", cap, 7, "g").count() == 0


def test_triplets_count_what_they_cannot_score(spark):
    v = spark.createDataFrame([("e", 1, [1.0, 0.0]), ("e", 2, [1.0, 0.0]), ("e", 3, [0.0, 1.0]), ("e", 4, [1.0, 0.0]), ("c", 1, [1.0]), ("e", 9, None)], SCHEMA)
    t = spark.createDataFrame([(1, 2, 3, "b"), (1, 2, 3, " C "), (1, 2, 4, "b"), (1, 2, 9, "b"), (1, 3, 77, "c"), (1, 3, 4, "c"), (None, 2, 3, "b")], "a long, b long, c long, choice string")
    found = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g"), (4, None)], "case_id long, finding string")
    strata = [r.label_stratum for r in V.triplet_strata(t, found, found).orderBy("a", "b", "c", "choice").collect()]
    assert sorted(strata) == sorted(["one_candidate_shares_a_finding"] * 3 + ["labels_unavailable"] * 3 + ["ambiguous_by_labels"])
    rows = {(r.encoder, r.conditioning): r for r in V.triplet_accuracy(V.triplet_strata(t, found, found), v, {"c": "consensus"}).collect()}
    r = rows["e", "all"]
    assert (r.triplet_acc, r.n_scored, r.n_tied, r.n_absent_case, r.n_triplets, r.encoder_kind) == (pytest.approx(2 / 3), 3, 1, 3, 7, "frozen_panel")
    assert ("c", "all") not in rows and rows["e", "one_candidate_shares_a_finding"].n_scored == 2
    assert V.triplet_accuracy(t, v.limit(0)).count() == 0


def test_arms_without_enough_cases(spark):
    r = np.random.default_rng(0)
    v = spark.createDataFrame([(e, i, r.normal(size=3).tolist()) for e in "ab" for i in range(30)], SCHEMA)
    cases = spark.createDataFrame([(i, "m" if i < 10 else "n", None if i % 2 else "s") for i in range(30)], "case_id long, maker string, site string")
    assert C.acquisition_arm(v, cases, "maker", 15, 3, 9).count() == 0 and C.acquisition_arm(v, cases, "maker", 9, 3, 9).first().manufacturers == "m;n"
    assert C.preprocessing_arm(v, v, 31, 3, 9).count() == 0
    same = C.preprocessing_arm(v, v, 8, 3, 9).first()
    assert same.n_draws == 4 and same.difference == pytest.approx(0, abs=1e-12) and same.native_mean == pytest.approx(same.harmonized_mean)
    rows = {x.pool: x for x in C.exposure_arm(v, cases, "clean_pool", 15, 3, ["clean"]).collect()}
    assert set(rows) == {"clean_pool", "clean_pool:s"} and not rows["clean_pool"].panel_saw_this_site


def test_summaries_of_few_rows(spark):
    from concord.operators import inference as I

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", None), ("c", 5.0)], "g string, v double")
    rows = {r.g: r for r in I.grouped_means(df, "v", ["g"], 50, 3).collect()}
    alone = I.bootstrap_mean(df.filter("g = 'a'"), "v", 50, 3).first()
    assert set(rows) == {"a", "c"} and rows["a"][1:] == pytest.approx((alone.point, alone.n, alone["std"], alone.ci_low, alone.ci_high)) and rows["c"]["std"] == 0
    assert I.grouped_means(df.limit(0), "v", ["g"], 5, tested=True).count() == 0
    ladder = spark.createDataFrame([("s", 0.6, None, 0.5, 0.1, 0.2, 99)], "step string, auroc_transfer double, reference_ci_high double, auroc_oracle double, retention double, p_fdr double, n_perm int")
    r = C.transfer_summary(C.with_transfer_columns(ladder)).first()
    assert r.share_above_reference_p975 is None and r.median_retention_chance_corrected is None and r.min_attainable_p == 0.01 and r.share_significant_fdr == 0
    few = spark.createDataFrame([("f", "a", "b", "x", "y", 8, 0.7, 0.9, 0.6)] * 4, "finding string, enc_train string, enc_eval string, objective_train string, objective_eval string, n_anchors int, auroc_xenc double, retention double, refit_anchor_b4 double")
    found = C.paired_summaries(few, [4], 8, replicates=20).collect()
    assert {(x.level, x.comparator) for x in found} == {(level, None) for level in ("finding", "encoder_pair", "objective_pair", "anchor_budget")}
    v = spark.createDataFrame([("e", i, [float(i)]) for i in range(40)], SCHEMA)
    cases = spark.createDataFrame([(i, i, "m") for i in range(40)], "case_id long, subject long, maker string")
    assert C.acquisition_predictability(v, cases, ["maker"], "subject").count() == 0 and C.acquisition_predictability(v, cases, ["maker"], "subject", least=5).count() == 0


def test_draws_of_one_scan_are_those_of_a_query_each(spark):
    rows = spark.range(700).select(F.col("id").alias("case_id"))
    got = sorted(map(tuple, S.capped_draws(rows, 9, 40, 3, "case_id").collect()))
    assert len(got) == 360 and [x for x in got if x[0] < 6] == sorted((i, r.case_id) for i in range(6) for r in S.capped(rows, 9, f"3:{i}", "case_id").collect())


def test_more_draws_than_a_product_can_number(spark):
    vectors = spark.range(8).select(F.lit("e").alias("encoder"), F.col("id").alias("case_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    drawn = spark.range(V.MOST_DRAWS + 1).select(F.col("id").cast("string").alias("draw")).crossJoin(vectors.select("case_id").limit(3))
    assert V.knn_edges_of_small_draws(vectors, drawn, 2).count() == 6 * (V.MOST_DRAWS + 1)
    few = drawn.filter("draw < '2'").limit(300)
    rows = [sorted(tuple(r)[:4] for r in f(vectors, few, 2).select("draw", "src", "dst", "rank").collect()) for f in (V.knn_edges_of_draws, V.knn_edges_of_small_draws)]
    assert rows[0] == rows[1]
