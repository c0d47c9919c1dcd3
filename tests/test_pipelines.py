"""Compositions on small made-up tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import vectors as V
from concord.plans import pipelines as C

VECTORS = "encoder string, case_id long, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.1 * r.normal(size=x.shape)
    return spark.createDataFrame([(e, i, v.tolist()) for e, m in (("a", x), ("b", y), ("n", r.normal(size=x.shape))) for i, v in enumerate(m)], VECTORS)


def test_dose_control_rises_from_chance(spark, vectors):
    clean = vectors.filter("encoder = 'a'")
    got = {r.encoder_b: r.value for r in C.cross_map(C.dosed_views(clean, [0.0, 0.6, 0.95]), ["clean"], ["dose_0.0", "dose_0.6", "dose_0.95"], 6).collect()}
    assert abs(got["dose_0.0"] - 6 / 119) < 0.04 and got["dose_0.0"] < got["dose_0.6"] < got["dose_0.95"]


def test_pairwise_map_and_summary(spark, vectors):
    got = C.pairwise_map(vectors, [3, 6], replicates=10, floor=["n"])
    rows = {(r.encoder_a, r.encoder_b, r.metric): r for r in got.collect()}
    assert len(rows) == 6 and rows["a", "b", "mknn_k6"].value > 0.5 > rows["a", "n", "mknn_k6"].value and rows["a", "n", "mknn_k6"].comparison_type == "floor"
    r = rows["a", "b", "mknn_k6"]
    assert r.value_ci_low <= r.value <= r.value_ci_high
    assert C.map_summary(got, 19).count() == 2


def test_finding_agreement_equals_graphs_per_finding(spark, vectors):
    positives = spark.range(120).select(F.col("id").alias("case_id"), F.when(F.col("id") < 40, "f").when(F.col("id") < 100, "g").otherwise("rare").alias("finding"))
    got = {(r.finding, r.encoder_a, r.encoder_b): r for r in C.finding_agreement(vectors, positives, 40, 4).collect()}
    assert {k[0] for k in got} == {"f", "g"} and all(r.n == 40 for r in got.values())
    own = vectors.filter("case_id < 40 AND encoder <> 'n'")
    want = A.mutual_knn(V.neighbour_lists(V.knn_edges(own, 4)), 4).first().mknn
    assert got["f", "a", "b"].mknn == pytest.approx(want)


def test_pool(spark, tmp_path):
    master = spark.createDataFrame([("p/1.png", "PA", "VAL", "2", "1"), ("p/2.png", "LL", "Train", "1", "0"), ("p/3.png", "AP", "test", "x", "3")], "image_key string, view string, split string, one string, two string").withColumn("image_subdir", F.lit(None).cast("string"))
    policies = spark.createDataFrame([("nih_cxr14", "one", "f", "v", 1.0, [0.0, 2.0]), ("nih_cxr14", "two", "f", "v", 1.0, [0.0])], "site string, native string, finding string, vocabulary string, positive double, negatives array<double>")
    got = {r.case_id: (r.split, r.f) for r in C.build_pool({"nih_cxr14": master}, policies, {"nih_cxr14": ["PA", "AP"]}, ["f"]).collect()}
    assert got == {"nih_cxr14__1": ("valid", 1.0), "nih_cxr14__3": ("test", None)}
    assert C.build_pool({"nih_cxr14": master}, policies, {}, ["f"], cap=2).count() == 2


def test_lists_in_cells(spark):
    df = spark.createDataFrame([("['Mass', 'No Finding']",), ("['No Finding']",), (None,)], "c string")
    got = df.select(L.has_category(F.col("c"), "Mass"), L.only_category(F.col("c"), "No Finding")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 1.0), (None, None)]


def test_usable_encoders(spark, vectors):
    cases = vectors.select("case_id").distinct()
    holes = vectors.withColumn("embedding", F.when(~((F.col("encoder") == "a") & (F.col("case_id") < 5)), F.col("embedding")))
    assert A.usable_encoders(holes, cases).select("case_id").distinct().count() == 115
    with pytest.raises(ValueError, match="encoders"):
        A.usable_encoders(vectors.filter("encoder = 'a' OR case_id < 3"), cases)
    assert A.consensus_state(1, 2, True) == "pending" and A.consensus_state(2, 2, False) == "not_converged"


def test_tails_and_references(spark):
    assert I.student_p(2.228, 10) == pytest.approx(0.05, abs=2e-4) and I.student_p(0.0, 5) == 1.0
    assert I.student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert I.correlation_p(0.5, 12) == pytest.approx(0.0979, abs=1e-3) and I.correlation_p(None, 9) is None
    got = I.gap_reference(0.8, [(50, 50), (20, 80), (0, 3)], 200)
    assert got["n_subgroups"] == 2 and 0 < got["reference_ci_low"] < got["reference_mean"] < got["reference_ci_high"]
    df = spark.createDataFrame([(0.5, 0.5 + 0.02 + i * 0.001) for i in range(10)], "a double, b double")
    assert I.paired_gain(df, "a", "b")["passed"] and not I.paired_gain(df, "b", "a")["passed"]
    shown = I.reported(spark.createDataFrame([(0.123, 1)], "point double, n int"), "x").first()
    assert shown.x_mean == 12.3 and shown.x_mean_raw == 0.123


def test_reader_study(spark):
    truth = spark.createDataFrame([(i, i, i % 2) for i in range(10)], "display_id int, case_id int, label int")
    right = truth.select("display_id", F.when(F.col("label") == 1, "yes").otherwise("No").alias("finding_present"))
    other = right.withColumn("finding_present", F.when(F.col("display_id") == 0, "yes").when(F.col("display_id") == 1, "?").otherwise(F.col("finding_present")))
    r = C.reader_study(right, other, truth).first()
    assert (r.accuracy_a, r.n_b) == (1.0, 9) and r.specificity_b == 0.8 and r.sensitivity_b == 1.0 and 0 < r.kappa < 1


def test_link_decision(spark):
    r = np.random.default_rng(4)
    units = [f"e{i}" for i in range(8)]
    pairs = [(a, b) for i, a in enumerate(units) for b in units[i + 1 :]]
    value = {p: float(x) for p, x in zip(pairs, r.normal(size=len(pairs)))}
    alignment = spark.createDataFrame([("mknn", a, b, v) for (a, b), v in value.items()], "metric string, pair_lo string, pair_hi string, alignment double")
    rows = [("anchor", n, a, b, "x", value[a, b] * 2 + float(r.normal()) * s, None) for n, s in ((256, 0.1), (64, 100.0)) for a, b in pairs]
    kept = spark.createDataFrame(rows, "route string, n_anchors int, pair_lo string, pair_hi string, objective_pair string, retention double, chance_corrected double")
    out = {(x.n_anchors, x.level): x for x in C.link_table(alignment, kept, ("anchor", "mknn", 256)).collect()}
    assert out[256, "all_pairs"].meets_rule and out[256, "all_pairs"].role == "primary" and out[256, "all_pairs"].rho > 0.9 and out[256, "all_pairs"].n_units == 8
    assert not out[64, "all_pairs"].meets_rule and (256, "objective_pair") in out
    with pytest.raises(ValueError):
        C.link_table(alignment, kept, ("anchor", "mknn", 1024))


def test_map_budgets_and_probe_reference(spark):
    from concord.operators import probes as P

    r = np.random.default_rng(5)
    y = r.integers(0, 2, 400)
    x = r.normal(size=(400, 4)) + y[:, None] * 1.5
    rows = [(e, int(i), (x[i] @ m).tolist(), int(y[i]), int(i) // 2) for e, m in (("a", np.eye(4)), ("b", r.normal(size=(4, 4)))) for i in range(400)]
    df = spark.createDataFrame(rows, "encoder string, case_id long, embedding array<double>, y int, subject int")
    train, test = df.filter("case_id < 250"), df.filter("case_id >= 250")
    sweep = P.map_budgets(train, test, ["y"], "a", "b", [50, 200])
    assert [round(v.retention, 2) for v in sweep.collect()] == [1.0, 1.0] and P.budget_summary(sweep).count() == 2
    for budget in (5, 300):
        with pytest.raises(ValueError):
            P.map_budgets(train, test, ["y"], "a", "b", [budget])
    found = P.probe_reference(df.filter("encoder = 'a'"), "y", "subject", "case_id", 3).first()
    assert found.auroc > 0.9 > 0.75 > found.reference_mean and found.excess > 0.2 and found.p_raw == 0.25
    assert P.probe_reference(df.filter("encoder = 'a' AND case_id < 100"), "y", "subject", "case_id", 3) is None


def test_graded_pool_is_cut_by_whole_subjects(spark):
    rows = [(i, f"{i}.png", i // 4, "Train" if i < 60 else "VAL", 40, "F", "PA", "2020", "r", i % 3, "x") for i in range(80)]
    master = spark.createDataFrame(rows, "image_id int, img_rel_path string, subject_id int, split string, age int, gender string, view string, study_date string, reader string, edema int, g string")
    pool = C.graded_pool(master, "graded", {"edema": "edema"}, [], ["g"], "reader", cap=40).collect()
    per = Counter(p.subject_id for p in pool)
    assert set(per.values()) == {4} and len(pool) <= 40 and {p.split for p in pool} == {"train", "valid"} and {p.grade__g for p in pool} == {None}


def test_site_policies(spark):
    from concord.functions.sites import CANONICAL, site_policies

    rows = site_policies(spark).collect()
    assert len(CANONICAL) == 14 and {r.finding for r in rows if r.vocabulary == "canonical"} == set(CANONICAL)
    assert {tuple(r.negatives) for r in rows if r.site == "mimic"} == {(0.0, 2.0)} and {tuple(r.negatives) for r in rows if r.site == "padchest"} == {(0.0,)}
