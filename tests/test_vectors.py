"""Neighbours with pruning, Gram matrices as merged pieces, ragged and absent vectors."""

import tracemalloc

import numpy as np
import pytest

from concord.operators import resampling as X
from concord.operators import vectors as V

SCHEMA = "encoder string, case_id long, embedding array<double>"


def brute(rows, k):
    out = set()
    good = [(e, c, np.array([*v, *[0.0] * (9 - len(v))])) for e, c, v in rows if e is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for e, c, v in good:
        near = sorted((-round(float(v @ w), 9), d) for f, d, w in good if f == e and d != c)
        out |= {(e, c, d, r + 1) for r, (_, d) in enumerate(near[:k])}
    return out


def cases(kind):
    r = np.random.default_rng(4)
    if kind == "clusters":
        centres = r.normal(size=(12, 6))
        points = np.array([centres[i % 12] / np.linalg.norm(centres[i % 12]) + r.normal(size=6) * 0.01 for i in range(360)])
        rows = [("a", i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(points)]
    else:
        rows = [("a", i, r.normal(size=6).tolist()) for i in range(360)]
    rows += [("b", i, r.integers(0, 3, 4).astype(float).tolist()) for i in range(60)]  # ties
    rows += [("c", 1, [1.0, 2.0]), ("c", 2, [1.0]), ("c", 3, []), ("c", 4, [1.0] * 9), ("c", 5, [1.0, None]), ("c", 6, None), ("c", 7, [float("nan")]), ("c", None, [1.0]), (None, 8, [1.0])]
    return rows


@pytest.mark.parametrize("kind", ["clusters", "uniform"])
def test_neighbours_equal_brute_force_and_skip_what_is_far(spark, monkeypatch, kind):
    monkeypatch.setattr(V, "ROWS_A_PIVOT", 20)
    rows = cases(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = V.knn_edges(df, 4, rows=30)
    assert {(r.encoder, r.src, r.dst, r["rank"]) for r in got.collect()} == brute(rows, 4)
    told = {r.encoder: r for r in V.block_pairs(df, 4, rows=30).collect()}
    share = told["a"].skipped / told["a"].pairs
    assert share > 0.5 if kind == "clusters" else share < 0.5


def test_blocks_are_bounded_by_components(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VALUES", 60)
    rows = [("a", i, [float(i % 7), 1.0, float(i)]) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks, n = V._blocks(df, 2048)
    assert n == 5 and max(len(r.data) for r in blocks.collect()) <= 8 * 3 * 40
    assert V.knn_edges(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("piece", [2, 64])
def test_grams_of_ragged_panels(spark, monkeypatch, piece):
    monkeypatch.setattr(V, "GRAM_ROWS", piece)
    r = np.random.default_rng(1)
    widths = {"a": 5, "b": 3, "c": 1}
    table = {e: {i: r.normal(size=w) for i in range(50) if (i + w) % 4} for e, w in widths.items()}
    rows = [(e, i, v.tolist()) for e, m in table.items() for i, v in m.items()]
    got = V.grams(spark.createDataFrame(rows, SCHEMA).repartition(6))
    for a in widths:
        for b in widths:
            shared = sorted(table[a].keys() & table[b].keys())
            x, y = (np.column_stack([np.stack([table[e][i] for i in shared]), np.ones(len(shared))]) for e in (a, b))
            assert got[a, b] == pytest.approx(x.T @ y)
    assert V.grams(spark.createDataFrame([], SCHEMA)) == {}


def test_relative_without_anchors_and_without_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, None), ("b", 9, [1.0]), ("c", 1, [2.0]), ("c", 4, [3.0, 1.0])]
    anchors = spark.createDataFrame([(2, 0), (1, 1)], "case_id long, pos int")
    got = {(r.encoder, r.case_id): r.relative for r in V.relative(spark.createDataFrame(rows, SCHEMA), anchors).collect()}
    assert got == {("a", 1): [0.0, 1.0], ("a", 2): [1.0, 0.0], ("a", 3): None, ("b", 9): [], ("c", 1): [4.0], ("c", 4): [6.0]}


def test_added_pieces(spark):
    rows = [(i % 3, np.arange(4.0) * i) for i in range(40)]
    df = spark.createDataFrame([(k, x.tobytes()) for k, x in rows], "k int, data binary").repartition(7)
    got = {r.k: np.frombuffer(r.data) for r in X.added(df, ["k"]).collect()}
    assert all(got[k] == pytest.approx(sum(x for j, x in rows if j == k)) for k in range(3))


def plain_nearest(sim, src, dst, k):
    sim = np.where(src[:, None] == dst[None], -np.inf, np.round(sim, V.DECIMALS))
    return {(i, int(j)) for i in range(len(sim)) for j in np.lexsort((np.arange(len(dst)), -sim[i]))[:k] if np.isfinite(sim[i, j])}


@pytest.mark.parametrize("columns", [3, 40, 900])
def test_nearest_equals_a_sort_of_each_row(columns):
    r = np.random.default_rng(columns)
    src, dst = np.arange(5, 65), np.sort(r.integers(0, 90, columns))
    for sim in (r.normal(size=(60, columns)), r.integers(0, 3, (60, columns)).astype(float), r.integers(0, 40, (60, columns)) + r.normal(size=(60, columns)) * 1e-14):
        sim[0, 0] = np.nan
        wanted = plain_nearest(np.where(np.isfinite(sim), sim, -np.inf), src, dst, 5)
        assert set(zip(*map(np.ndarray.tolist, V.nearest(sim.copy(), src, dst, 5)))) == wanted


def test_nearest_leaves_out_what_is_below_the_bound():
    sim, at = np.random.default_rng(0).normal(size=(200, 200)), np.arange(200)
    least = np.sort(np.where(np.eye(200) > 0, -9.0, sim), axis=1)[:, -3]
    i, j = V.nearest(sim.copy(), at, at, 10, least)
    assert (np.bincount(i) == 3).all() and {*zip(i.tolist(), j.tolist())} == plain_nearest(sim, at, at, 3)
    assert not len(V.nearest(sim.copy(), at, at, 10, np.full(200, 99.0))[0])


@pytest.mark.parametrize("values", [1 << 23, 60])
def test_triplets_do_not_carry_vectors(spark, monkeypatch, values):
    monkeypatch.setattr(V, "SIDE_VALUES", values)
    monkeypatch.setattr(V, "CELL_PAIRS", 64)
    r = np.random.default_rng(5)
    x = r.normal(size=(50, 6))
    rows = [(i, x[i].tolist()) for i in range(50)] + [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (52, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "case_id long, embedding array<double>")
    t = [tuple(map(int, z)) for z in r.integers(0, 55, (300, 3))] + [(None, 1, 2), (3, 4, 4)]
    found = V.triplet_choice(spark.createDataFrame([(k, *z) for k, z in enumerate(t)], "t long, a long, b long, c long"), v)
    wanted = {k: "b" if x[a] @ x[b] > x[a] @ x[c] else "c" for k, (a, b, c) in enumerate(t) if a is not None and max(a, b, c) < 50 and b != c}
    assert {r.t: r.nearer for r in found.collect()} == wanted and found.columns == ["t", "a", "b", "c", "distance_b", "distance_c", "nearer"]
    assert "zip_with" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e100])
def test_two_blocks_meet_once_and_single_precision_tells_nothing(spark, monkeypatch, scale):
    monkeypatch.setattr(V, "SIDE_VALUES", 256)  # four strips of an encoder
    r = np.random.default_rng(6)
    base = r.normal(size=4)
    rows = [(e, i, (scale ** 0.5 * (base + 1e-8 * r.normal(size=4))).tolist()) for e in "ab" for i in range(200)] + [("b", 500 + i, [scale**0.5] * 4) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for x in V.knn_edges(df, 5, rows=20).collect():
        got.setdefault((x.encoder, x.src), []).append((x["rank"], x.similarity))
    for e, n in (("a", 200), ("b", 260)):
        m = np.array([v for f, _, v in rows if f == e])
        sim = m @ m.T
        np.fill_diagonal(sim, -np.inf)
        want = np.sort(sim, axis=1)[:, ::-1][:, :5]
        for (_, src), own in ((k, v) for k, v in got.items() if k[0] == e):
            at = [i for i, (f, c, _) in enumerate(x for x in rows if x[0] == e) if c == src][0]
            assert np.allclose([s for _, s in sorted(own)], want[at], rtol=1e-12, atol=1e-12) and len(own) == 5
    for t in V.block_pairs(df, 5, rows=20).collect():
        blocks = (8 * t.pairs + 1) ** 0.5
        assert blocks == int(blocks)  # n (n + 1) / 2 of n blocks


@pytest.mark.parametrize("same", [False, True])
def test_draws_of_two_blocks_take_one_comparison_and_a_strip_of_products(same):
    r = np.random.default_rng(8)
    n, k = 2048, 4
    m = r.normal(size=(2 * n, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[n : n + 40] = m[:40]  # copies in the other block
    m[100:130] = m[200:230]
    ids = np.arange(2 * n)
    ids[-3:] = [0, 1, 2]  # further vectors of cases of the first block
    order = n + np.argsort(ids[n:], kind="stable")
    x, y = V._Rows(ids[:n], m[:n]), V._Rows(ids[order], m[order])
    y = x if same else y
    draws = [(np.arange(n), np.arange(len(y.ids))), tuple(np.sort(r.choice(len(b.ids), 1400, replace=False)) for b in (x, y))]
    draws = [(a, a if same else b) for a, b in draws]
    sides, strip = [], np.empty(n * n // 16, np.float32)
    for a, b in draws:
        bests = [V._Best(len(w), k, V._bounds(block.part(w), k)) for block, w in ((x, a), (y, b))]
        assert min(b.least for b in bests) > 0
        sides.append((a, b, bests[0], None if same else bests[1]))
    tracemalloc.start()
    assert V._meet_settled(x, y, sides, strip)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n * n  # less than the products of the blocks in single precision
    for a, b, one, other in sides:
        for best, p, q, mine, theirs in ((one, x, y, a, b), (other, y, x, b, a)):
            if best is None:
                continue
            sim = np.round(p.m[mine] @ q.m[theirs].T, V.DECIMALS)
            sim[p.ids[mine][:, None] == q.ids[theirs]] = -np.inf
            found, bound = {}, V._bounds(p.part(mine), k)
            for i, d, s in zip(*best.settled()):
                found.setdefault(i, []).append((d, s))
            for i, row in enumerate(sim):
                near = np.flatnonzero(row >= bound[i])
                near = near[np.argsort(-row[near], kind="stable")][:k]
                assert [d for d, s in found.get(i, []) if s >= bound[i]] == q.ids[theirs][near].tolist()


def test_bounds_are_reached_by_k_others():
    r = np.random.default_rng(9)
    for n, k, scale in ((300, 5, 1.0), (40, 5, 1.0), (6, 5, 1.0), (5, 5, 1.0), (64, 3, 1e100)):
        rows = V._Rows(np.sort(r.integers(0, n, n)), np.concatenate([np.ones((n // 3, 8)), r.normal(size=(n - n // 3, 8))]) * scale)
        sim = rows.m @ rows.m.T
        sim[rows.ids[:, None] == rows.ids] = -np.inf
        bound = V._bounds(rows, k)
        assert ((sim >= bound[:, None]).sum(1)[np.isfinite(bound)] >= k).all()
        assert np.isfinite(bound).any() == (n > 6 and scale == 1.0) or n == 6


@pytest.mark.parametrize("copies", [1, 30])
def test_draws_of_many_rows_equal_brute_force(spark, copies):
    r = np.random.default_rng(10)
    n, k = 2400, 3
    base = r.normal(size=(n // copies, 24))
    m = np.concatenate([base] * copies)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    level = {f"d{d}": np.flatnonzero(r.integers(0, 3, n) == 0) if d else np.arange(n)[::2] for d in range(3)}
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    drawn = spark.createDataFrame([(int(i), d) for d, own in level.items() for i in own], "case_id long, draw string")
    got = {}
    for x in V.knn_edges_of_draws(df, drawn, k, rows=600).collect():
        got.setdefault((x.draw, x.src), []).append((x["rank"], x.dst))
    for d, own in level.items():
        sim = np.round(m[own] @ m[own].T, V.DECIMALS)
        np.fill_diagonal(sim, -np.inf)
        for i, row in zip(own, sim):
            near = np.lexsort((own, -row))[:k]
            assert [j for _, j in sorted(got.pop((d, int(i))))] == own[near].tolist()
    assert not got
