"""The consensus of a panel: audit, residuals against the vectors themselves, guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.plans import pipelines as C

SCHEMA = "encoder string, case_id long, embedding array<double>"


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 4))
    m = {e: np.column_stack([base @ r.normal(size=(4, 3)), r.normal(size=(60, w)) * 0.1]) for e, w in (("a", 2), ("b", 4), ("c", 0))}
    rows = [(e, i, None if (e == "c" and i >= 55) else v.tolist()) for e, x in m.items() for i, v in enumerate(x)]
    anchors = spark.createDataFrame([(i, i) for i in range(5)], "case_id long, pos int")
    return m, spark.createDataFrame(rows, SCHEMA).repartition(3), anchors


def test_residuals_are_those_of_the_vectors(spark, panel):
    m, df, anchors = panel
    found = C.consensus(df, anchors, ["a", "b", "c"], k=5)
    rows = sorted(found.vectors.collect())
    agreed = np.array([r.embedding for r in rows])
    assert [r.case_id for r in rows] == list(range(55)) and np.linalg.norm(agreed) == pytest.approx(1) and found.state == "ready"
    told = {r.encoder: r for r in found.residuals.collect()}
    for e, x in m.items():
        rel = x[:55] @ x[:5].T
        rel = rel - rel.mean(0)
        rel /= np.linalg.norm(rel)
        best = 2 - 2 * np.linalg.svd(rel.T @ agreed, compute_uv=False).sum()
        assert told[e].residual == pytest.approx(best, abs=1e-8) and told[e].converged
    assert {r.encoder: (r.status, round(r.finite_row_fraction, 4)) for r in found.audit.collect()} == {"a": ("USED", 1.0), "b": ("USED", 1.0), "c": ("USED", 0.9167)}
    assert found.deviations.filter("deviation IS NOT NULL").count() == 55


def test_too_little_is_left(spark, panel):
    _, df, anchors = panel
    with pytest.raises(ValueError, match="2 of 3 encoders"):
        C.consensus(df.filter("encoder <> 'c'"), anchors, ["a", "b", "c"])
    with pytest.raises(ValueError, match="too few cases"):
        C.consensus(df.withColumn("embedding", F.when((F.col("encoder") != "b") | (F.col("case_id") % 3 != 0) | (F.col("case_id") < 5), F.col("embedding"))), anchors, ["a", "b", "c"])
    audit = {r.encoder: r.status for r in C.consensus_audit(df.withColumn("embedding", F.when((F.col("encoder") != "a") | (F.col("case_id") < 9), F.col("embedding"))), ["a", "b", "z"]).collect()}
    assert audit == {"a": "SKIPPED_MOSTLY_NAN", "b": "USED", "z": "MISSING"}
    few = C.consensus(df, anchors, ["a", "b", "c"], k=3, deviation_cases=20)
    assert few.deviations.count() == 55 and few.deviations.filter("deviation IS NOT NULL").count() == 20
