"""Queries over whole tables against brute force on small ones, with rows that a prefix by id would miss."""

import hashlib
import random

import numpy as np
import pytest

from concord.operators import agreement as A
from concord.operators import resampling as X
from concord.plans.catalogue import all_queries

R = random.Random(5)
TYPES = ["click", "view", "buy"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('whole')}"
    events = [(i, R.choice(TYPES), R.random() * 900, R.randrange(90)) for i in range(1000)]
    spark.createDataFrame(events, "event_id long, event_type string, value double, user_id long").write.parquet(f"{folder}/events.parquet")
    turns = [(c, t, r, f"{r} {c} {t}") for c in range(6) for t, r in ((0, "assistant"), (1, "other"), (2, "system"), (3, "user"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = np.random.default_rng(3).normal(size=(260, 64))
    spark.createDataFrame([(i + 7, v.tolist(), i % 4) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    orders = [(i, R.randrange(5000)) for i in range(1, 3000, 13)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return folder, events, vectors, orders


def run(spark, name, tables):
    return all_queries()[0][name](spark, tables[0]).collect()


def key(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def order_of(seed, b, n):
    return np.argsort(X.keys_of(seed, b, np.arange(n)), kind="stable")


def test_permutations_of_all_events(spark, tables):
    events = tables[1]
    values = np.array([e[2] for e in events]) / 100
    first = np.array([e[1] == "view" for e in events])
    gap = lambda v, m: np.mean(v[m]) - np.mean(v[~m])
    observed, n = gap(values, first), int(first.sum())
    draws = [gap(values[order_of(7, b, 1000)], np.arange(1000) < n) for b in range(1000)]
    (row,) = run(spark, "permutation_2_whole", tables)
    assert (row.n_a, row.n_b) == (n, 1000 - n) and row.gain_mean_raw == pytest.approx(observed, abs=1e-6) and row.gain_unit == "percentage_points"
    assert row.p_raw == pytest.approx((sum(abs(x) >= abs(observed) for x in draws) + 1) / 1001)
    (row,) = run(spark, "permutation_k_whole", tables)
    assert row.k_groups == 8 and [float(x) for x in row.group_means_pct.split(";")] == [pytest.approx(np.mean([e[2] for e in events if e[3] % 8 == k]) * 100, abs=0.06) for k in range(8)]
    assert run(spark, "reader_variance_share_whole", tables)[0].n == 1000


def test_false_discovery_over_all_events(spark, tables):
    p = {i: v / 1000 for i, _, v, _ in tables[1] if i % 7}
    order = sorted(p, key=p.get, reverse=True)
    wanted, least = {}, 1.0
    for at, i in enumerate(order):
        wanted[i] = least = min(least, p[i] * len(p) / (len(p) - at))
    got = {r.event_id: r.p_fdr for r in run(spark, "bh_fdr", tables)}
    assert len(got) == 1000 and {i for i, x in got.items() if x is None} == set(range(0, 1000, 7))
    assert all(got[i] == pytest.approx(x) for i, x in wanted.items())


def test_range_over_all_users(spark, tables):
    cells = {}
    for _, kind, value, user in tables[1]:
        cells.setdefault(user, {}).setdefault(kind, []).append(value)
    means = [np.mean([np.mean(c[t]) for c in cells.values() if len(c) == 3]) for t in TYPES]
    (row,) = run(spark, "subgroup_range", tables)
    assert row.observed_range == pytest.approx(max(means) - min(means), abs=1e-6) and row.n_groups == 3


def test_sections_of_all_turns(spark, tables):
    assert {(r.conv_id, r.report) for r in run(spark, "section_combine", tables)} == {(c, f"system {c} 2\nuser {c} 3") for c in range(6)}


def test_triplets_and_structure_of_all_vectors(spark, tables):
    _, _, x, orders = tables
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = set()
    for o, c in orders:
        a, b, d = x[o % 260], x[c % 260], x[(o + c) % 260]
        if abs(a @ b - a @ d) >= 1e-9:
            wanted.add((o, "b" if a @ b > a @ d else "c"))
    assert {(r.tid, r.nearer) for r in run(spark, "triplet_choice", tables)} == wanted
    label, raw = np.arange(260) % 4, tables[2]
    raw = raw[np.argsort(label, kind="stable")]

    def distance(rows):
        centres = np.array([rows[65 * k : 65 * k + 65].mean(0) for k in range(4)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        return np.mean(1 - (centres @ centres.T)[np.triu_indices(4, 1)])

    got = {r.b: r.mean_distance for r in run(spark, "structural_reference", tables)}
    assert len(got) == 10 and all(got[b] == pytest.approx(distance(raw[order_of(0, b, 260)]), abs=1e-6) for b in got)
    (row,) = run(spark, "structural_reference_whole", tables)
    draws = [distance(raw[order_of(0, b, 260)]) for b in range(200)]
    assert row.mean_distance == pytest.approx(distance(raw), abs=1e-6) and row.reference_mean == pytest.approx(np.mean(draws), abs=1e-6)
    assert row.p_value == pytest.approx((sum(x >= distance(raw) for x in draws) + 1) / 201)


def test_samples_of_pairs(spark, tables):
    assert run(spark, "rsa_spearman_whole", tables)[0].n == 260 * 259 // 2
    df = spark.createDataFrame([(e, i, v[:8].tolist()) for e, at in (("a", 0), ("b", 8)) for i, v in enumerate(tables[2][:, at:])], "encoder string, case_id long, embedding array<double>")
    chosen = sorted(range(260), key=lambda i: (key(0, i), i))[:50]
    assert A.rbf_cka(df, "a", "b", 50) == pytest.approx(A.rbf_cka(df.filter(df.case_id.isin(chosen)), "a", "b"))
    assert A.rbf_cka(df, "a", "b", 50) != pytest.approx(A.rbf_cka(df.filter("case_id < 50"), "a", "b"))
