"""Probes fitted together against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import probes as P
from concord.operators import resampling as X


def exact(x, y, c=P.C):
    """Newton's method on scaled vectors with balanced weights, to the end."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    ridge, b = np.r_[np.full(x.shape[1], 1 / c), 0.0], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), z.T @ (w * (p - y)) + ridge * b)
    raw = b[:-1] / scale
    return np.r_[raw, b[-1] - raw @ mean]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5)) * [1, 5, 0.1, 1, 1] + 3
    x[:, 3] = 7.0  # does not vary
    y = (x[:, 0] + r.normal(size=400) > 3).astype(int)
    z = [None if i % 3 == 0 else int(x[i, 1] > 4) for i in range(400)]
    rows = [(i, x[i].tolist(), int(y[i]), z[i], 1, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id long, embedding array<double>, y int, z int, same int, encoder string").repartition(3)
    return x, y, z, df


def test_several_labels_at_once(spark, data, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 60)
    monkeypatch.setattr(P, "HESSIANS", 300)  # a response at a time
    x, y, z, df = data
    found = P.fit_probes(df, ["y", "z", "same"]).coefficients[""]
    known = [i for i in range(400) if z[i] is not None]
    assert found[:, 0] == pytest.approx(exact(x, y), abs=1e-6) and found[:, 1] == pytest.approx(exact(x[known], np.array([z[i] for i in known])), abs=1e-6)
    assert (found[:, 2] == 0).all()
    one = P.fit_probe(df, "y").score(df).select("case_id", "score")
    both = P.fit_probes(df, ["y"]).scores(df).join(one, "case_id").select((F.col("scores")[0] - F.col("score")).alias("d"))
    assert both.agg(F.max(F.abs("d"))).first()[0] < 1e-3


def test_groups_and_absent_vectors(spark, data):
    x, y, _, df = data
    more = df.unionByName(df.limit(3).withColumn("embedding", F.lit(None).cast("array<double>"))).unionByName(df.limit(3).withColumn("encoder", F.lit(None).cast("string")))
    probes = P.fit_probes(more, ["y"], group=F.col("encoder"))
    for k, e in enumerate("ab"):
        assert probes.coefficients[e][:, 0] == pytest.approx(exact(x[k::2], y[k::2]), abs=1e-6)
    scored = probes.scores(more.withColumn("encoder", F.when(F.col("case_id") == 5, "c").otherwise(F.col("encoder"))), F.col("encoder"))
    assert scored.filter("scores IS NULL").count() == 7 and len(P.fit_probes(df.limit(0), ["y"]).coefficients) == 0


def test_labels_in_random_orders(spark, data):
    x, y, _, df = data
    found = P.fit_permuted(df, "y", ["case_id"], 12, 3).coefficients[""]
    order = np.argsort(y, kind="stable")
    ones = int(y.sum())
    assert found[:, 0] == pytest.approx(exact(x, y), abs=1e-6)
    for b in range(12):
        moved = np.zeros(400)
        moved[np.argsort(X.keys_of(3, b, np.arange(400)))[400 - ones :]] = 1
        assert found[:, b + 1] == pytest.approx(exact(x[order], moved), abs=1e-6)


def test_budgets_classes_and_findings(spark, data):
    x, y, _, df = data
    train, test = df.filter("case_id < 250"), df.filter("case_id >= 250")
    found = {r.draw: r for r in P.budget_refits(train, test, "y", 40, 5).collect()}
    assert len(found) == 5
    for b in (0, 4):
        ids = [r.case_id for r in P.budget_draw(train, "y", 40, b, 0, "case_id").collect()]
        coefficients = exact(x[ids], y[ids], 1.0)
        want = P._plain_auroc(x[250:] @ coefficients[:-1], y[250:])
        assert found[b].auroc == pytest.approx(want, abs=1e-6) and found[b].n_positive == y[250:].sum()
    rows = df.withColumn("k", F.when(F.col("case_id") % 40 == 1, 2).otherwise(F.col("y")))
    few = P.multiclass_accuracy(rows.filter("case_id < 250"), rows.filter("case_id >= 250"), "k").first()
    assert few.n_classes == 2 and few.n == rows.filter("case_id >= 250 AND k < 2").count() and P.multiclass_accuracy(rows.limit(0), rows, "k") is None
    got = {r.finding: r.auroc for r in P.finding_aurocs(train, test, ["y", "z", "same"]).collect()}
    coefficients = exact(x[:250], y[:250])
    assert set(got) == {"y", "z"} and got["y"] == pytest.approx(P._plain_auroc(x[250:] @ coefficients[:-1], y[250:]), abs=1e-6)
    assert P.finding_aurocs(train, test, ["same"]) is None


def test_weighted_auroc_counts_copies():
    r = np.random.default_rng(0)
    score, y, w = r.integers(0, 5, 60).astype(float), r.integers(0, 2, 60), r.integers(0, 3, 60)
    assert P._weighted_auroc(score, y, w.astype(float)) == pytest.approx(P._plain_auroc(np.repeat(score, w), np.repeat(y, w)))
