"""Replicates inside tasks: borders against a full sort, draws that add up, cells against one cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import resampling as X


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(X, "CELL_ROWS", 64)
    monkeypatch.setattr(X, "CHUNK", 7)


def rows_of(spark, n, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, float(r.normal()), float(r.integers(0, 4)), int(r.random() < 0.4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, l int").repartition(3)


def order_of(seed, b, n):
    return np.argsort(X.keys_of(seed, b, np.arange(n)), kind="stable")


@pytest.mark.parametrize("sizes", [[300], [1, 299], [100, 50, 1, 149], [3] * 100])
def test_borders_and_sums_equal_a_full_sort(spark, small, sizes):
    rows, df = rows_of(spark, 300)
    places = X.placed_rows(df, ["id"], ["x", "y"])
    assert places.table.count() == 5
    got = X.permuted_sums(places, sizes, 20, 3)
    x, ends = np.array([r[1:3] for r in rows]), np.cumsum([0, *sizes])
    for b in range(-1, 20):
        moved = x if b < 0 else x[order_of(3, b, 300)]
        assert got[b + 1] == pytest.approx(np.array([moved[a:z].sum(0) for a, z in zip(ends, ends[1:])]))
    borders = [int(e) for e in ends[1:-1]]
    for b, keys in enumerate(X.border_keys(places, borders, range(20), 3) if borders else []):
        own = X.keys_of(3, b, np.arange(300))
        assert [(own < k).sum() for k in keys] == borders


def test_part_of_the_rows_and_a_window_that_misses(spark, small, monkeypatch):
    rows, df = rows_of(spark, 300)
    places = X.placed_rows(df, ["id"], ["x"])
    x = np.array([r[1] for r in rows])
    assert X.permuted_sums(places, [40], 9, 1)[1:, 0, 0] == pytest.approx([x[order_of(1, b, 300)[:40]].sum() for b in range(9)])
    real = X.np.sqrt
    monkeypatch.setattr(X.np, "sqrt", lambda v: real(v) * (0 if isinstance(v, np.ndarray) and v.ndim == 1 else 1))  # windows without room
    borders = X.border_keys(places, [150], range(30), 1)
    assert [(X.keys_of(1, b, np.arange(300)) < k).sum() for b, (k,) in enumerate(borders)] == [150] * 30


def test_permuted_products_and_triangles(spark, small):
    rows, df = rows_of(spark, 200)
    x = np.array([r[1:3] for r in rows])
    got = X.permuted_products(X.placed_rows(df, ["id"], ["x", "y"]), [0, 1], [1], 10, 5)
    for b in range(-1, 10):
        assert got[b + 1] == pytest.approx(x.T @ (x[:, [1]] if b < 0 else x[order_of(5, b, 200)][:, [1]]))
    m = np.abs(x[:30, [0]] - x[:30, 0])
    got = X.permuted_triangles(m, m, df, 5, 2)
    for b in range(-1, 5):
        o = np.arange(30) if b < 0 else order_of(2, b, 30)
        assert got[b + 1] == pytest.approx(np.triu(m * m[np.ix_(o, o)], 1).sum())


def test_draws_add_up_and_spread_as_multinomial_numbers():
    sizes = [64, 64, 1, 640, 30, 64]
    drawn = np.array([X.draws_of(c, sizes, 4000, 9) for c in range(6)])
    assert (drawn[:, 0] == sizes).all() and (drawn[:, 1:].sum(0) == sum(sizes)).all()
    n = sum(sizes)
    for size, m in zip(sizes, drawn[:, 1:]):
        assert m.mean() == pytest.approx(size, rel=0.1) and m.var() == pytest.approx(size * (1 - size / n), rel=0.15)
    counts = np.array([1, 0, 5, 2])
    assert X.weights(0, 3, 0, 8, counts)[1] == 0 and X.weights(0, 3, 0, 8, counts).sum() == 8 and (X.weights(0, -1, 0, 8, counts) == counts).all()
    many = np.array([X.weights(0, b, 0, 80_000, np.array([20_000, 60_000])) for b in range(500)])
    assert (many.sum(1) == 80_000).all() and many[:, 0].var() == pytest.approx(15_000, rel=0.3)


def test_cells_hold_equal_values_together_and_sum_as_the_table(spark, small):
    rows, df = rows_of(spark, 500)
    cells = X.value_cells(df, ["y"])
    assert cells.n == 500 and cells.table.count() == len(cells.sizes) <= 4
    cells = X.value_cells(df, ["x", "y"])
    sums = X.bootstrap_sums(cells, lambda v: np.column_stack([v, np.ones(len(v))]), 3, 50, 2)
    x = np.array([r[1:3] for r in rows])
    assert len(cells.sizes) == 8 and sums[0] == pytest.approx([*x.sum(0), 500]) and (sums[:, 2] == 500).all()
    assert sums[1:, 0].std() == pytest.approx(x[:, 0].std() * 500**0.5, rel=0.3)


def auc(score, label, w):
    p, q = label == 1, label == 0
    wins = (score[p][:, None] > score[q]) + 0.5 * (score[p][:, None] == score[q])
    return w[p] @ wins @ w[q] / (w[p].sum() * w[q].sum())


@pytest.mark.parametrize("score", ["x", "y"])
def test_aurocs_over_cells(spark, small, score):
    rows, df = rows_of(spark, 400)
    k = {"x": 1, "y": 2}[score]
    cells = X.value_cells(df, [score], "l")
    found = X.bootstrap_aurocs(cells, 20, 4)
    entries = sorted({(r[k]) for r in rows})
    counts = {(v, l): sum(r[k] == v and r[3] == l for r in rows) for v in entries for l in (0, 1)}
    at, drawn = 0, []
    for c, size in enumerate(cells.sizes):  # the entries of each cell
        own, n = [], 0
        while n < size:
            own.append(entries[at])
            n += counts[entries[at], 0] + counts[entries[at], 1]
            at += 1
        flat = np.array([counts[v, l] for v in own for l in (0, 1)])
        m = X.draws_of(c, cells.sizes, 20, 4)
        drawn.append([X.weights(4, b - 1, c, int(m[b]), flat) for b in range(21)])
    values, labels = np.repeat(entries, 2), np.tile([0, 1], len(entries))
    for b in range(21):
        assert found[b] == pytest.approx(auc(values, labels, np.concatenate([d[b] for d in drawn]).astype(float)))


def test_rank_correlation_of_draws(spark, small):
    rows, df = rows_of(spark, 150)
    cells = X.value_cells(df, ["y", "x"])
    found = X.bootstrap_rank_correlations(cells, 5, 1)
    entries = np.array(sorted((r[2], r[1]) for r in rows))
    w, at = [], 0
    for c, size in enumerate(cells.sizes):
        m = X.draws_of(c, cells.sizes, 5, 1)
        w.append([X.weights(1, b - 1, c, int(m[b]), np.ones(size, int)) for b in range(6)])
    for b in range(6):
        drawn = np.repeat(entries, np.concatenate([x[b] for x in w]), axis=0)
        ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in drawn.T]
        assert found[b] == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_empty_and_constant_tables(spark):
    none = spark.createDataFrame([], "id long, x double, y double, l int, g string")
    assert tuple(I.bootstrap_mean(none, "x", 5).first())[:2] == (None, 0) and I.bootstrap_auroc(none, "l", "x", 5).first().point is None
    assert I.bootstrap_spearman(none, "x", "y", ["id"], 5).first().n == 0 and I.bootstrap_slope(none, "x", "y", 5).first().std is None and I.paired_bootstrap(none, "x", "y", 5).first().p_value is None
    assert I.permutation_two(none, "x", "g", "a", ["id"], 5).first().p_value is None and I.permutation_groups(none, "x", "g", ["id"], 5).first().p_value is None
    assert I.kappa_permutation(none, "l", "l", ["id"], 5).count() == 0 and I.variance_share_reference(none, "x", "g", ["id"], 5).count() == 0 and I.subsample_mean(none, "x", ["id"], None, 5).first().point is None
    assert I.mantel_entries(none, "x", "y", ["id"], 5).first().n == 0
    same = spark.createDataFrame([(i, 1.0, 2.0, i % 2, "ab"[i % 2]) for i in range(30)], "id long, x double, y double, l int, g string")
    assert I.bootstrap_mean(same, "x", 50).first().std == 0 and I.bootstrap_spearman(same, "x", "y", ["id"], 5).first().point is None and I.bootstrap_slope(same, "x", "y", 5).first().n_draws == 0
    assert I.bootstrap_auroc(same, "l", "x", 50).first().point == 0.5 and I.permutation_two(same, "x", "g", "a", ["id"], 9).first().p_value == 1.0 and I.mantel_entries(same, "x", "y", ["id"], 5).first().p_value is None
    shares = {r.block: r for r in A.block_reference(same, "id", "x", {"one": ["y"], "two": ["l"]}, 5).collect()}
    assert shares["one"].r2_unique is None and {r.block for r in A.block_reference(none, "id", "x", {"one": ["y"]}, 5).collect()} == {"one"}
    v = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, None, 3), (3, [0.0, 1.0], None)], "case_id long, embedding array<double>, label int")
    assert A.structural_reference(v, "label", "case_id", 3).count() == 0


def test_mantel_of_a_triangle_and_of_a_part(spark):
    r = np.random.default_rng(1)
    names = [f"o{i}" for i in range(9)]
    pairs = [(a, b, float(r.integers(0, 9)), float(r.normal())) for i, a in enumerate(names) for b in names[i + 1 :]]
    df, objects = spark.createDataFrame(pairs, "a string, b string, x double, y double"), spark.createDataFrame([(n,) for n in names], "o string")
    ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in np.array([p[2:] for p in pairs]).T]
    at = {(p[0], p[1]): k for k, p in enumerate(pairs)}
    draws = []
    for b in range(99):
        to = [names[k] for k in order_of(0, b, 9)]
        draws.append(np.corrcoef(ranks[0], [ranks[1][at[tuple(sorted((to[names.index(p[0])], to[names.index(p[1])])))]] for p in pairs])[0, 1])
    own = np.corrcoef(*ranks)[0, 1]
    row = I.mantel(df, "a", "b", "x", "y", objects, 99).first()
    assert row.spearman == pytest.approx(own) and row.n == 36 and row.p_value == pytest.approx((sum(abs(d) >= abs(own) - 1e-9 for d in draws) + 1) / 100)
    part = df.filter("NOT (a = 'o0' AND b = 'o1')")
    assert tuple(I.mantel(part, "a", "b", "x", "y", objects, 20).first()) == tuple(I.mantel_entries(part, "x", "y", ["a", "b"], 20).first())
    assert I._mantel_by_joins(df, "a", "b", "x", "y", objects, 9, 0).first().spearman == pytest.approx(own)


def test_large_groups_take_the_way_by_rows(spark, monkeypatch):
    _, df = rows_of(spark, 120)
    few = I.permutation_groups(df, "x", "y", ["id"], 9).first()
    monkeypatch.setattr(I, "MOST_GROUPS", 2)
    many = I.permutation_groups(df, "x", "y", ["id"], 9).first()
    assert many.f == pytest.approx(few.f) and 0 < many.p_value <= 1
    assert I.variance_share_reference(df, "x", "y", ["id"], 9).first().n_groups == 4
    assert I.two_group_report(df, "x", "l", 1, ["id"], replicates=9).first().n_a == df.filter(F.col("l") == 1).count()


def test_draws_of_rows_are_not_broadcast(spark):
    df = spark.range(400).selectExpr("id", "id * 2.0 AS x", "id % 50 AS c")
    for drawn in (I.resampled(df, ["id"], 50, 0), I.resampled_clusters(df, "c", 50, 0)):
        plan = drawn._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin [cast(i" in plan and "BroadcastHashJoin [cast(i" not in plan
    assert I.resampled(df, ["id"], 50, 0).count() == 50 * 400


def test_entries_in_parts_are_permuted_alike(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(r.integers(0, 90)), float(r.normal())) for i in range(700)], "id long, x double, y double")
    few = I.mantel_entries(df, "x", "y", ["id"], 60).first()
    monkeypatch.setattr(X, "ENTRIES", 256)
    monkeypatch.setattr(X, "CELL_ROWS", 128)
    for side in (1 << 24, 300):
        monkeypatch.setattr(X, "SIDE_ROWS", side)
        many = I.mantel_entries(df, "x", "y", ["id"], 60).first()
        assert many.spearman == pytest.approx(few.spearman) and (many.n, many.p_value) == (few.n, few.p_value)


@pytest.mark.parametrize("side,most,narrow", [(1 << 24, 1 << 26, 1 << 31), (300, 1 << 26, 1 << 31), (300, 400, 1 << 31), (300, 400, 10)])
def test_rank_products_in_parts_equal_a_full_sort(spark, small, monkeypatch, side, most, narrow):
    for name, value in (("SIDE_ROWS", side), ("MOST_ROWS", most), ("NARROW", narrow), ("COUNTED", 150)):
        monkeypatch.setattr(X, name, value)
    x = np.random.default_rng(2).integers(-400, 400, (700, 2)) / 2
    places = X.placed_rows(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double"), ["id"], ["x", "y"])
    got = X.permuted_rank_products(places, 12, 4)
    assert got.tolist() == [x[:, 0] @ x[:, 1], *(x[:, 0] @ x[order_of(4, b, 700), 1] for b in range(12))]


def test_part_of_the_key_space_is_sorted_with_its_values(monkeypatch):
    monkeypatch.setattr(X, "COUNTED", 150)
    n, keys = 1000, X.keys_of(7, 3, np.arange(1000))
    assert np.concatenate([k.copy() for _, k in X.first_keys(7, 3, n)]).tolist() == (keys >> 30).tolist()
    y = np.random.default_rng(0).integers(-(2**31), 2**31, n).astype(np.int32)
    for low, high in ((0, 1 << 32), (0, 1 << 31), (3 << 29, 1 << 32), (1 << 30, 3 << 30)):
        own = [i for i in np.argsort(keys) if low <= keys[i] >> 30 < high]
        for start, stop in ((0, n), (130, 710), (150, 300), (0, 1)):
            for kind in (np.int32, np.float64):
                below, values = X._of_part(7, 3, n, low, high, start, y[start:stop].astype(kind))
                assert below == (keys >> 30 < low).sum() and values.tolist() == [y[i] if start <= i < stop else 0 for i in own]


def test_keys_below_edges_are_those_that_comparison_counts():
    keys = X.keys_of(3, 5, np.arange(5000))
    edges = np.sort(np.r_[0, keys[:50], keys[:50] + 1, np.random.default_rng(1).integers(0, 1 << 62, 200), 1 << 62])
    assert X.below(keys, edges).tolist() == [(keys < e).sum() for e in edges]


def test_counts_come_from_as_many_tasks_as_keep_the_cores_busy(spark):
    rows = spark.range(40 * X.CELL_ROWS).select("id", F.lit(1.0).alias("x"))
    assert X._tasks(X.placed_rows(rows, ["id"], ["x"])) == min(40, 2 * spark.sparkContext.defaultParallelism)


def test_means_of_large_groups_draw_as_sql_does_in_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "PART_VALUES", 900)
    monkeypatch.setattr(I, "PART_COPIES", 2)
    n = X.HASHED + 4321
    df = spark.range(n).selectExpr("'big' AS g", "CAST(id * id % 2003 AS double) / 7 AS v", "CAST(NULL AS string) AS h").unionByName(spark.range(50).selectExpr("'small' AS g", "CAST(id AS double) AS v", "'x' AS h"))
    rows = {r.g: r for r in I.grouped_means(df, "v", ["g", "h"], 7, 3, tested=True).collect()}
    for g, x in (("big", np.sort(np.arange(n) ** 2 % 2003 / 7)), ("small", np.arange(50.0))):
        draws = np.array([x[(X.mixed(3, b, 0, np.arange(len(x))).astype(np.int64) * len(x)) >> 32].mean() for b in range(7)])
        p = max(float((np.abs(draws - x.mean()) >= abs(x.mean()) * (1 - 1e-9)).mean()), 1 / 7)
        assert rows[g][2:] == pytest.approx((x.mean(), len(x), draws.std(ddof=1), *np.percentile(draws, [2.5, 97.5]), p), rel=1e-9)
    assert rows["big"].h is None and rows["small"].h == "x"
