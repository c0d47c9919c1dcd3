"""Properties and NumPy twins of the relational, statistical and vector operators."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import order as O
from concord.operators import probes as P
from concord.operators import relational as R
from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.sources.shared import cut

VECTORS = "encoder string, case_id long, embedding array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, **encoders):
    return spark.createDataFrame([(e, i, v.tolist()) for e, m in encoders.items() for i, v in enumerate(m)], VECTORS)


@pytest.fixture(scope="module")
def sample():
    r = np.random.default_rng(0)
    x = unit(r.normal(size=(90, 8)))
    return x, unit(x + 0.6 * r.normal(size=x.shape))


def slow_knn(x, k):
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    return np.array([sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))])


# sampling


def test_samples(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") < 30, 1).when(F.col("id") < 150, 0).alias("y"))
    capped = Counter(r.g for r in S.cap_per_group(df, "g", 10, 1, "id").collect())
    assert capped == {0: 10, 1: 10, 2: 10}
    assert S.cap_per_group(df, "g", 0, 1, "id").count() == 200
    assert Counter(r.y for r in S.balanced(df, "y", 50, 1, "id").collect()) == {1: 30, 0: 30}
    assert S.balanced(df.filter("y = 1"), "y", 5, 1, "id").count() == 0
    assert S.matched_draw(df.filter("g < 2 or id < 30"), "g", 20, 1, "id").groupBy("g").count().count() == 2
    assert S.capped(df, 7, 1, "id").collect() == S.capped(df.repartition(5), 7, 1, "id").collect()


def test_greedy_packing(spark):
    sizes = {0: 5, 1: 4, 2: 3, 3: 9, 4: 2, 5: 1}
    df = spark.createDataFrame([(u, 0) for u, n in sizes.items() for _ in range(n)], "unit int, g int")
    order = [r.unit for r in df.select("unit").distinct().orderBy(S.hash_key(3, F.col("unit")), "unit").collect()]
    fitting, taken = set(), 0
    for u in order:
        if taken < 10 and taken + sizes[u] <= 10:
            fitting.add(u)
            taken += sizes[u]
    until, n = set(), 0
    for u in order:
        if n >= 10:
            break
        until.add(u)
        n += sizes[u]
    assert {r.unit for r in S.take_fitting(df, "unit", 10, 3, "g").collect()} == fitting
    assert {r.unit for r in S.take_until(df, "unit", 10, 3).collect()} == until


def test_unit_split_is_disjoint(spark):
    df = spark.range(300).select("id", (F.col("id") % 40).alias("u"))
    parts = defaultdict(set)
    for r in S.unit_split(df, "u", 5).collect():
        parts[r.part].add(r.u)
    assert len(parts["train"]) == 28 and not parts["train"] & parts["test"] and len(parts["test"]) == 12
    assert {r.part for r in S.unit_split(df.filter("u = 3"), "u", 5).collect()} == {"train"}


def test_anchors_are_distinct_and_ordered(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"))
    got = S.anchors(df, ["a", "b"], 20, 1, "id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(20)) and len({r.id for r in got}) == 20
    assert all(r.id % 2 for r in got[:10])


# relational


def test_audits_and_counts(spark):
    df = spark.createDataFrame([("a", "train", 1.0, None), ("a", "test", 0.0, 1.0), ("b", "test", None, 1.0), (None, "test", None, 0.0)], "s string, split string, x double, y double")
    assert [tuple(r) for r in R.split_leaks(df, "s", "split").collect()] == [("a", 2)]
    got = {r.finding: (r.n_labeled, r.n_positive, r.n_negative, r.prevalence) for r in R.prevalence(df, ["x", "y"]).collect()}
    assert got == {"x": (2, 1, 1, 0.5), "y": (3, 2, 1, 0.666667)}
    assert R.any_positive(df, ["x", "y"]).count() == 3 and R.complete(df, ["x", "y"]).count() == 1
    assert R.duplicate_keys(df, ["split"]).collect()[0].n_rows == 3
    pairs = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f"), (2, "f"), (3, "h")], "c int, f string")
    jac = {(r.finding_a, r.finding_b): (r.n_co_occurrence, r.n_union, r.jaccard) for r in R.comorbidity(pairs, "c", "f").collect()}
    assert jac["f", "g"] == (1, 2, 0.5) and jac["f", "h"] == (0, 3, 0.0) and jac["f", "f"] == (2, 2, 1.0)


def test_conform_and_patch(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    out = R.conform(df, {"a": "string", "new": "double"})
    assert out.columns == ["a", "new", "b"] and out.first().new is None
    fixes = [(F.col("a") == "x", "b", F.lit(9))]
    assert R.patched(R.patched(df, fixes), fixes).first().b == 9
    assert R.union_all(df, spark.createDataFrame([(2,)], "b int")).filter("a IS NULL").count() == 1


# inference


def test_ranks_agree_with_windows(spark):
    r = np.random.default_rng(1)
    values = [(str(g), float(x)) for g, x in zip(r.choice(["a", "b"], 200), r.integers(0, 9, 200))] + [(None, 3.0), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(values, "g string, x double").repartition(5)
    for by in ([], ["g"]):
        got = sorted((str(r.g), r.x, r.r) for r in I.ranked(df, "x", "r", by).collect())
        of = lambda g: [x for h, x in values if not by or h == g]
        assert got == sorted((str(g), x, sum(y < x for y in of(g)) + (sum(y == x for y in of(g)) + 1) / 2) for g, x in values)


def test_positions_and_running_sums(spark):
    rows = [(i % 3, i * 7 % 100, i) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, k int, n int").repartition(7)
    for by in ([], ["g"]):
        got = {(r.g, r.k): r.at for r in O.positions(df, ["k"], "at", by).collect()}
        assert got == {(g, k): sum(1 for h, j, _ in rows if j < k and (not by or h == g)) for g, k, _ in rows}
    summed = O.carried(O.spread(df, ["g", "k"]), ["k"], "n", "before", ["g"]).collect()
    assert {(r.g, r.k): r.before for r in summed} == {(g, k): sum(m for h, j, m in rows if h == g and j < k) for g, k, _ in rows}


def test_auroc_and_kappa(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(r.integers(0, 2, 120), r.integers(0, 20, 120))], "y int, s double")
    rows = df.collect()
    pos, neg = [x.s for x in rows if x.y], [x.s for x in rows if not x.y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert I.auroc(df, "y", "s").first().auroc == pytest.approx(want)
    assert I.auroc(df.withColumn("s", -F.col("s")), "y", "s").first().auroc == pytest.approx(1 - want)
    assert I.auroc(df.filter("y = 1"), "y", "s").first().auroc is None
    assert I.kappa(df, "y", "y").first().kappa == 1.0


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.2, None, 0.04, 0.9]
    got = {r.i: r.p_fdr for r in I.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    q, low = {}, 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        q[known[rank - 1][1]] = low
    assert got.pop(4) is None and got == pytest.approx(q)
    assert all(got[i] >= p[i] for i in got)


def test_jackknife_and_bootstrap(spark):
    pairs = spark.createDataFrame([(a, b, 3.0) for a in "abcde" for b in "abcde" if a < b], "a string, b string, v double")
    r = I.jackknife_units(pairs, "a", "b", F.avg("v")).first()
    assert (r.point, r.std, r.n_units) == (3.0, 0.0, 5)
    df = spark.range(60).select("id", (F.col("id") % 5).cast("double").alias("v"), (F.col("id") % 4).cast("string").alias("c"))
    b = I.bootstrap_mean(df, "v", 100).first()
    assert b.point == 2.0 and b.ci_low < 2.0 < b.ci_high and I.bracketed(I.bootstrap_mean(df, "v", 100), "point", "ci_low", "ci_high").count() == 1
    assert I.cluster_bootstrap_mean(df, "v", "c", 50).first().n == 60
    with pytest.raises(Exception, match="no cluster"):
        I.cluster_bootstrap_mean(df.withColumn("c", F.when(F.col("id") > 3, F.col("c"))), "v", "c", 5).collect()
    assert I.block_jackknife(df, "v", "id").first().n_blocks == 20


def test_permutations(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b", float(i >= 20) * 5 + i % 3) for i in range(40)], "i int, g string, v double").withColumnRenamed("i", "id")
    assert I.permutation_two(df, "v", "g", "a", ["id"], 99).first().p_value == pytest.approx(0.01)
    assert I.permutation_groups(df, "v", "g", ["id"], 99).first().p_value == pytest.approx(0.01)
    assert I.permutation_two(df.filter("id < 21"), "v", "g", "a", ["id"], 9).first().p_value is None


def test_permuted_in_pieces_equals_one_order_of_hashes(spark):
    import hashlib

    df = spark.createDataFrame([(i, i * 3) for i in range(500)], "k int, v int").repartition(4)
    want = {}
    for b in range(3):
        order = sorted(range(500), key=lambda i: (hashlib.md5(f"7|{b}|{i}".encode()).hexdigest(), i))
        want |= {(b, place): i * 3 for place, i in enumerate(order)}
    for piece in (1000, 100, 5):
        assert {(r.b, r.i): r.v for r in I.permuted(df, "v", ["k"], 3, 7, piece).collect()} == want


def test_residuals_and_slope(spark):
    r = np.random.default_rng(3)
    z = r.normal(size=80)
    x, y = z + r.normal(size=80), 2 * z + r.normal(size=80)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, y, z)], "x double, y double, z double")
    ex, ey = (v - np.polyval(np.polyfit(z, v, 1), z) for v in (x, y))
    want = np.corrcoef(np.argsort(np.argsort(ex)), np.argsort(np.argsort(ey)))[0, 1]
    assert I.partial_spearman(df, "x", "y", "z").first().partial_spearman == pytest.approx(want)
    assert I.slope(df, "z", "y").first().slope == pytest.approx(np.polyfit(z, y, 1)[0])
    assert I.normal_p(1.96, 1.0) == pytest.approx(0.05, abs=1e-3) and I.normal_p(1.0, 0.0) is None
    assert I.detectable_effect(1.0) == pytest.approx(2.8016, abs=1e-3)


# vectors and agreement


@pytest.mark.parametrize("rows", [2048, 20])
def test_neighbours_equal_brute_force(spark, sample, rows):
    x, _ = sample
    x = np.vstack([x, x[:3]])  # ties
    got = defaultdict(list)
    for r in V.knn_edges(frame(spark, a=x), 5, rows).orderBy("src", "rank").collect():
        got[r.src].append(r.dst)
    assert [got[i] for i in range(len(x))] == slow_knn(x, 5).tolist()


@pytest.mark.parametrize("rows", [700, 5000])
def test_equal_vectors_give_few_edges(spark, rows, monkeypatch):
    same = np.tile([0.6, 0.8], (2000, 1))
    emitted = []
    real = V.nearest
    pairs = real(same[:300] @ same.T, np.arange(300), np.arange(2000), 4)
    emitted.append(len(pairs[0]))
    assert emitted == [1200]
    got = V.knn_edges(frame(spark, a=same), 4, rows).collect()
    assert len(got) == 8000 and {r.dst for r in got if r.src == 0} == {1, 2, 3, 4} and {r.dst for r in got if r.src == 1999} == {0, 1, 2, 3}


def test_rows_without_encoder_case_or_vector_have_no_neighbours(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), (None, 3, [1.0, 0.0]), ("a", None, [1.0, 0.0]), ("a", 4, None), ("b", 1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "encoder string, case_id long, embedding array<double>")
    assert sorted((r.encoder, r.src, r.dst) for r in V.knn_edges(df, 3).collect()) == [("a", 1, 2), ("a", 2, 1)]
    assert V.knn_edges(df.limit(0), 3).count() == 0


def test_vectors_that_do_not_vary_agree_to_zero(spark, sample):
    x = sample[0][:30]
    df = frame(spark, a=x, b=np.ones_like(x))
    assert A.linear_cka(V.grams(df), "a", "b") == 0.0 and A.rbf_cka(df, "a", "b") == 0.0


def test_suite_and_safe_agreement(spark, sample):
    x, y = sample[0][:60].copy(), sample[1][:60]
    df = frame(spark, a=x, b=y)
    suite = A.metric_suite(df, "a", "b", (4, 6), primary=6)
    lists = V.neighbour_lists(V.knn_edges(df, 6))
    assert suite["mknn_k6"] == suite["headline_mknn"] == pytest.approx(A.mutual_knn(lists, 6).first().mknn)
    assert suite["procrustes"] == pytest.approx(A.procrustes(V.grams(df), "a", "b")) and set(suite) >= {"cka_rbf", "rsa_spearman", "cknna_k4", "cknna_binary_graph_k4"}
    bad = df.withColumn("embedding", F.when((F.col("encoder") == "a") & (F.col("case_id") < 45), F.array(F.lit(float("nan")))).otherwise(F.col("embedding")))
    r = A.safe_mutual_knn(bad, "a", "b", 3).first()
    assert r.n == 15 and r.mknn is None


def test_mutual_neighbours(spark, sample):
    x, y = sample
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(8, 8)))[0]
    lists = V.neighbour_lists(V.knn_edges(frame(spark, a=x, b=y, c=x @ q), 5))
    got = {(r.encoder_a, r.encoder_b): r.mknn for r in A.mutual_knn(lists, 5).collect()}
    nx, ny = slow_knn(x, 5), slow_knn(y, 5)
    assert got["a", "c"] == 1.0 and got["a", "b"] == pytest.approx(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(nx, ny)]))
    every = A.case_agreement(lists, 5).collect()
    assert len(every) == len(x) and all(r.deviation == pytest.approx(1 - r.all_jaccard) for r in every)


def test_sparse_agreement_equals_dense(spark, sample):
    x, y = sample
    n, k = len(x), 5
    edges = cut(V.knn_edges(frame(spark, a=x, b=y), k))

    def hsic(a, b):
        a, b = a.copy(), b.copy()
        np.fill_diagonal(a, 0)
        np.fill_diagonal(b, 0)
        return ((a * b.T).sum() + a.sum() * b.sum() / ((n - 1) * (n - 2)) - 2 * a.sum(0) @ b.sum(1) / (n - 2)) / (n * (n - 3))

    masks = []
    for m in (x, y):
        mask = np.zeros((n, n))
        mask[np.repeat(np.arange(n), k), slow_knn(m, k).ravel()] = 1
        masks.append(mask)
    kx, ky = masks[0] * (x @ x.T), masks[1] * (y @ y.T)
    want = hsic(kx * masks[1], ky * masks[0]) / np.sqrt(hsic(kx, kx) * hsic(ky, ky))
    assert A.cknna(edges, "a", "b", n, k) == pytest.approx(want)
    h = np.eye(n) - 1 / n
    trace = lambda a, b: np.trace(a @ h @ b @ h)
    want = trace(*masks) / np.sqrt(trace(masks[0], masks[0]) * trace(masks[1], masks[1]))
    assert A.cknna_binary(edges, "a", "b", n, k) == pytest.approx(want)
    assert A.cknna(edges, "a", "b", 4, k) is None


def test_gram_measures(spark, sample):
    x, y = sample
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(8, 8)))[0]
    g = V.grams(frame(spark, a=x, b=y, c=x @ q, d=3 * x))
    assert A.procrustes(g, "a", "c") == pytest.approx(0, abs=1e-6) and A.linear_cka(g, "a", "d") == pytest.approx(1)
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert A.linear_cka(g, "a", "b") == pytest.approx(np.linalg.norm(yc.T @ xc) ** 2 / np.linalg.norm(xc.T @ xc) / np.linalg.norm(yc.T @ yc))
    u, _, v = np.linalg.svd(y.T @ x)
    assert A.procrustes(g, "a", "b") == pytest.approx(np.linalg.norm(x - y @ u @ v) / np.sqrt(len(x)))
    m = A.affine_map(g, "a", "b")
    assert np.allclose(m, np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0])
    residual, history, done = A.generalised_procrustes(g, ["a", "c", "d"])
    assert done and max(residual.values()) < 1e-6
    residual, history, done = A.generalised_procrustes(g, ["a", "b", "c"])
    assert done and history[-1] <= history[0] + 1e-9 and all(0 < v < 1 for v in residual.values())


def test_rsa_and_gaussian_kernel(spark, sample):
    x, y = (m[:40] for m in sample)
    df = frame(spark, a=x, b=y, c=x @ np.linalg.qr(np.random.default_rng(6).normal(size=(8, 8)))[0])
    assert A.rsa(df, "a", "a").first().spearman == pytest.approx(1)
    at = np.triu_indices(40, 1)
    rank = lambda v: np.argsort(np.argsort(v))
    assert A.rsa(df, "a", "b").first().spearman == pytest.approx(np.corrcoef(rank((x @ x.T)[at]), rank((y @ y.T)[at]))[0, 1])
    assert A.rbf_cka(df, "a", "c") == pytest.approx(1) and 0 < A.rbf_cka(df, "a", "b") < 1


def test_relative_vectors_and_centroids(spark, sample):
    x, _ = sample
    df = frame(spark, a=x)
    anchors = spark.createDataFrame([(5, 0), (2, 1)], "case_id long, pos int")
    got = {r.case_id: r.relative for r in V.relative(df, anchors).collect()}
    assert np.allclose([got[i] for i in range(len(x))], x @ x[[5, 2]].T)
    c = V.centroids(df.withColumn("g", F.col("case_id") % 2), "g").orderBy("g").collect()
    mean = x[::2].mean(0)
    assert np.allclose(c[0].centroid, mean / np.linalg.norm(mean))
    s = x.sum(0)
    assert V.mean_cosine(df, ["encoder"]).first().mean_cosine == pytest.approx((s @ s - len(x)) / (len(x) * (len(x) - 1)))
    assert V.finite_rows(spark.createDataFrame([("a", 1, [1.0, None]), ("a", 2, [float("nan")]), ("a", 3, [1.0]), ("a", 4, None)], VECTORS)).count() == 1


def test_r_squared_of_blocks(spark):
    r = np.random.default_rng(7)
    a, b = r.normal(size=200), r.normal(size=200)
    y = 2 * a + 0.5 * b + r.normal(size=200)
    g = V.grams(spark.createDataFrame([("x", i, [float(y[i]), float(a[i]), float(b[i])]) for i in range(200)], VECTORS))["x", "x"]
    full = 1 - np.linalg.lstsq(np.c_[a, b, np.ones(200)], y, rcond=None)[1][0] / ((y - y.mean()) ** 2).sum()
    got = A.block_r_squared(g, 0, {"a": [1], "b": [2]})
    assert got["full"]["alone"] == pytest.approx(full) and got["a"]["unique"] == pytest.approx(full - got["b"]["alone"])
    assert A.r_squared(np.array([[4.0, 2.0], [2.0, 1.0]]), 0, []) is None


def test_triplets(spark):
    v = spark.createDataFrame([("e", 1, [1.0, 0.0]), ("e", 2, [0.9, 0.1]), ("e", 3, [0.0, 1.0])], VECTORS)
    t = spark.createDataFrame([(1, 2, 3), (1, 3, 2), (1, 2, 2), (1, 2, 9)], "a long, b long, c long")
    assert sorted((r.b, r.nearer) for r in V.triplet_choice(t, v).collect()) == [(2, "b"), (3, "c")]


# probes


def test_probe_transfer_and_stitching(spark):
    r = np.random.default_rng(8)
    y = r.integers(0, 2, 300)
    x = r.normal(size=(300, 4)) + 1.5 * y[:, None]
    q = r.normal(size=(4, 4))
    rows = [("a", i, x[i].tolist(), int(y[i])) for i in range(300)] + [("b", i, (x @ q + 1)[i].tolist(), int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS + ", y int")
    train, test = df.filter("case_id < 200"), df.filter("case_id >= 200")
    target = P.fit_probe(train.filter("encoder = 'b'"), "y")
    own = I.auroc(target.score(test.filter("encoder = 'b'")), "y", "score").first().auroc
    matrix = A.affine_map(V.grams(train.select("encoder", "case_id", "embedding")), "a", "b")
    moved = I.auroc(target.score(P.mapped(test.filter("encoder = 'a'"), matrix)), "y", "score").first().auroc
    assert own > 0.95 and moved == pytest.approx(own, abs=1e-3)
    assert not P.usable(train.filter("y = 1"), "y", 5)
