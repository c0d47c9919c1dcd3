"""Agreement between representations of the same cases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators import resampling as X
from concord.operators.inference import spearman
from concord.operators.sampling import capped
from concord.operators.vectors import finite_rows, grams, knn_edges, neighbour_lists
from concord.sources.shared import cut


def encoder_pairs(lists: DataFrame) -> DataFrame:
    """(encoder_a, encoder_b, case_id, n_a, n_b) for every two encoders, each graph used as it is."""
    a = lists.select(F.col("encoder").alias("encoder_a"), "case_id", F.col("neighbours").alias("n_a"))
    b = lists.select(F.col("encoder").alias("encoder_b"), "case_id", F.col("neighbours").alias("n_b"))
    return a.join(b, "case_id").filter("encoder_a < encoder_b")


def row_overlap(lists: DataFrame, k: int) -> DataFrame:
    """(encoder_a, encoder_b, case_id, overlap): share of the k nearest neighbours that two encoders share."""
    shared = F.size(F.array_intersect(F.slice("n_a", 1, k), F.slice("n_b", 1, k)))
    return encoder_pairs(lists).select("encoder_a", "encoder_b", "case_id", (shared / float(k)).alias("overlap"))


def mutual_knn(lists: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Mean overlap of every two encoders; NULL below `least` shared cases."""
    return row_overlap(lists, k).groupBy("encoder_a", "encoder_b").agg(F.when(F.count("*") >= least, F.avg("overlap")).alias("mknn"), F.count("*").alias("n"))


def case_agreement(lists: DataFrame, k: int) -> DataFrame:
    """For each case: mean overlap over encoder pairs, Jaccard of all encoders' neighbours, and 1 minus it."""
    pairs = row_overlap(lists, k).groupBy("case_id").agg(F.avg("overlap").alias("mean_overlap"))
    sets = lists.groupBy("case_id").agg(F.collect_list(F.slice("neighbours", 1, k)).alias("s"))
    common = F.aggregate("s", F.col("s")[0], F.array_intersect)
    every = F.array_distinct(F.flatten("s"))
    jaccard = F.size(common) / F.size(every)
    return pairs.join(sets.select("case_id", jaccard.alias("all_jaccard"), (1 - jaccard).alias("deviation")), "case_id")


def _graph(edges: DataFrame, encoder: str, weight: Column) -> DataFrame:
    return edges.filter(F.col("encoder") == encoder).select("src", "dst", weight.alias("w"))


def _sums(a: DataFrame, b: DataFrame, n: int) -> dict[str, float]:
    """Sum of A_ij B_ji, sums of A and of B, and sum over i of A's column sum times B's row sum, and the other way."""
    t = a.join(b.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v")), ["src", "dst"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0]
    parts = {}
    for name, g in (("a", a), ("b", b)):
        parts[name, "row"] = g.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("r"))
        parts[name, "col"] = g.groupBy(F.col("dst").alias("i")).agg(F.sum("w").alias("c"))
    ab = parts["a", "col"].join(parts["b", "row"], "i").agg(F.sum(F.col("c") * F.col("r"))).first()[0]
    ba = parts["b", "col"].join(parts["a", "row"], "i").agg(F.sum(F.col("c") * F.col("r"))).first()[0]
    return {"t": t or 0.0, "a": a.agg(F.sum("w")).first()[0] or 0.0, "b": b.agg(F.sum("w")).first()[0] or 0.0, "ab": ab or 0.0, "ba": ba or 0.0}


def hsic_unbiased(a: DataFrame, b: DataFrame, n: int) -> float:
    """Unbiased HSIC of two sparse kernels without diagonals, as edge lists (src, dst, w) over n cases."""
    s = _sums(a, b, n)
    return (s["t"] + s["a"] * s["b"] / ((n - 1) * (n - 2)) - 2 * s["ab"] / (n - 2)) / (n * (n - 3))


def cknna(edges: DataFrame, encoder_a: str, encoder_b: str, n: int, k: int) -> float | None:
    """Similarity-weighted agreement of two k-graphs; None for too few cases or a degenerate one."""
    if n <= max(k + 1, 3):
        return None
    a, b = (_graph(edges.filter(F.col("rank") <= k), e, F.col("similarity")) for e in (encoder_a, encoder_b))
    both_a, both_b = a.join(b.select("src", "dst"), ["src", "dst"], "left_semi"), b.join(a.select("src", "dst"), ["src", "dst"], "left_semi")
    scale = max(hsic_unbiased(a, a, n), 0.0) * max(hsic_unbiased(b, b, n), 0.0)
    return hsic_unbiased(both_a, both_b, n) / scale**0.5 if scale > 0 else None


def cknna_binary(edges: DataFrame, encoder_a: str, encoder_b: str, n: int, k: int) -> float:
    """Agreement of two k-graphs as 0/1 adjacency by centred traces; 0 if one is degenerate."""
    a, b = (_graph(edges.filter(F.col("rank") <= k), e, F.lit(1.0)) for e in (encoder_a, encoder_b))

    def trace(x: DataFrame, y: DataFrame) -> float:
        s = _sums(x, y, n)
        return s["t"] - s["ab"] / n - s["ba"] / n + s["a"] * s["b"] / (n * n)

    scale = trace(a, a) * trace(b, b)
    return trace(a, b) / scale**0.5 if scale > 0 else 0.0


def _centred(g: np.ndarray) -> np.ndarray:
    """Cross-covariance sums from a Gram matrix with the extra component."""
    return g[:-1, :-1] - np.outer(g[:-1, -1], g[-1, :-1]) / g[-1, -1]


def linear_cka(grams: dict, a: str, b: str) -> float:
    """Linear kernel alignment; 0 where one side does not vary."""
    x, y, xy = _centred(grams[a, a]), _centred(grams[b, b]), _centred(grams[a, b])
    scale = np.linalg.norm(x) * np.linalg.norm(y)
    return float((xy**2).sum() / scale) if scale > 0 else 0.0


def procrustes(grams: dict, a: str, b: str) -> float:
    """Root mean squared distance after the best rotation, without centring or scaling."""
    n = grams[a, b][-1, -1]
    spread = np.trace(grams[a, a][:-1, :-1]) + np.trace(grams[b, b][:-1, :-1])
    return float(np.sqrt(max(0.0, spread - 2 * np.linalg.svd(grams[a, b][:-1, :-1], compute_uv=False).sum()) / n))


def affine_map(grams: dict, a: str, b: str) -> np.ndarray:
    """Least-squares map with intercept from a's vectors to b's: a matrix of (d_a + 1) rows."""
    return np.linalg.lstsq(grams[a, a], grams[a, b][:, :-1], rcond=None)[0]


def r_squared(gram: np.ndarray, outcome: int, columns: list[int]) -> float | None:
    """R² of a linear model with intercept from a Gram matrix whose last component is 1; None without variance."""
    total = gram[outcome, outcome] - gram[outcome, -1] ** 2 / gram[-1, -1]
    if total <= 0:
        return None
    at = [*columns, len(gram) - 1]
    beta = np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, outcome], rcond=None)[0]
    return float(1 - (gram[outcome, outcome] - beta @ gram[at, outcome]) / total)


def block_r_squared(gram: np.ndarray, outcome: int, blocks: dict[str, list[int]]) -> dict[str, dict[str, float | None]]:
    """For each block of columns: R² alone, and what the full model loses without it."""
    everything = [c for cols in blocks.values() for c in cols]
    full = r_squared(gram, outcome, everything)
    out = {"full": {"alone": full, "unique": None}}
    for name, cols in blocks.items():
        rest = r_squared(gram, outcome, [c for c in everything if c not in cols])
        out[name] = {"alone": r_squared(gram, outcome, cols), "unique": None if full is None or rest is None else full - rest}
    return out


def generalised_procrustes(grams: dict, encoders: list[str], iterations: int = 2000, tolerance: float = 1e-6) -> tuple[dict[str, float], list[float], bool]:
    """(residual of each encoder, mean residual by iteration, converged) of the rotation to a common consensus."""
    return consensus_maps(grams, encoders, iterations, tolerance)[:3]


def consensus_maps(grams: dict, encoders: list[str], iterations: int = 2000, tolerance: float = 1e-6) -> tuple[dict[str, float], list[float], bool, dict[str, np.ndarray]]:
    """generalised_procrustes() with the map of each encoder's vectors, an affine one of (d + 1) rows, whose sum over the encoders is the consensus.

    Vectors are centred and scaled. Rotations depend on the encoders' Gram matrices alone, so the
    rows are read once and the iterations are on the driver: consensus = sum of M_k A_k.
    """
    scale = {e: np.sqrt(np.trace(_centred(grams[e, e]))) or 1.0 for e in encoders}
    d = max(len(grams[e, e]) - 1 for e in encoders)
    cross = {}
    for a in encoders:
        for b in encoders:
            g = np.zeros((d, d))
            c = _centred(grams[a, b]) / (scale[a] * scale[b])
            g[: c.shape[0], : c.shape[1]] = c
            cross[a, b] = g
    weights = {e: np.eye(d) * (e == encoders[0]) for e in encoders}

    def maps(w: dict) -> dict[str, np.ndarray]:
        out = {}
        for e in encoders:
            g = grams[e, e]
            linear = w[e][: len(g) - 1] / scale[e]
            out[e] = np.vstack([linear, -(g[-1, :-1] / g[-1, -1]) @ linear])
        return out

    def rotations(w: dict) -> tuple[dict, dict]:
        r, onto = {}, {}
        for e in encoders:
            u, s, v = np.linalg.svd(sum(cross[e, o] @ w[o] for o in encoders))
            r[e], onto[e] = u @ v, s.sum()
        return r, onto

    history: list[float] = []
    for _ in range(iterations):
        r, onto = rotations(weights)
        size = sum(np.trace(weights[a].T @ cross[a, b] @ weights[b]) for a in encoders for b in encoders)
        residual = {e: np.trace(cross[e, e]) + size - 2 * onto[e] for e in encoders}
        history.append(float(np.mean(list(residual.values()))))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tolerance:
            return {e: float(x) for e, x in residual.items()}, history, True, maps(weights)
        mean = {e: r[e] / len(encoders) for e in encoders}
        length = np.sqrt(sum(np.trace(mean[a].T @ cross[a, b] @ mean[b]) for a in encoders for b in encoders))
        weights = {e: mean[e] / (length or 1.0) for e in encoders}
    return {e: float(x) for e, x in residual.items()}, history, False, maps(weights)


def similarity_pairs(vectors: DataFrame, encoder_a: str, encoder_b: str, largest: int = 5000) -> DataFrame:
    """(i, j, s_a, s_b): inner products of every two cases of a sample, in two encoders; more than `largest` cases are refused.

    The sample goes to every task, which multiplies its own cases by it.
    """
    of = lambda e: F.first(F.when(F.col("encoder") == e, F.col("embedding")), ignorenulls=True)
    rows = cut(vectors.groupBy("case_id").agg(of(encoder_a).alias("va"), of(encoder_b).alias("vb")).dropna())
    if (n := rows.count()) > largest:
        raise ValueError(f"{n} cases make too many pairs: draw a sample of at most {largest}")
    sample = rows.orderBy("case_id").toArrow()
    dense = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
    every = (sample.column(0).to_numpy(), dense(sample.column(1)), dense(sample.column(2))) if n else None
    shared = vectors.sparkSession.sparkContext.broadcast(every)
    schema = T.StructType([T.StructField("i", rows.schema["case_id"].dataType), T.StructField("j", rows.schema["case_id"].dataType), T.StructField("s_a", T.DoubleType()), T.StructField("s_b", T.DoubleType())])

    def run(batches):
        ids, x, y = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = part.column(0).to_numpy()
                r, c = np.nonzero(own[:, None] < ids[None])
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array((dense(part.column(1)) @ x.T)[r, c]), pa.array((dense(part.column(2)) @ y.T)[r, c])], names=schema.names)

    return rows.repartition(max(1, n // 250)).mapInArrow(run, schema)


def rsa(sample: DataFrame, encoder_a: str, encoder_b: str) -> DataFrame:
    """Spearman correlation of the similarities of all pairs of a sample of at most a few thousand cases."""
    return spearman(similarity_pairs(sample, encoder_a, encoder_b), "s_a", "s_b")


def rbf_cka(sample: DataFrame, encoder_a: str, encoder_b: str, largest: int = 2000) -> float:
    """Gaussian-kernel CKA on at most `largest` cases, the first by hash, with the first encoder's median distance as width for both.

    `largest` bounds what comes to the driver. Where one side does not vary, the value is 0.
    """
    wide = sample.filter(F.col("encoder").isin(encoder_a, encoder_b)).groupBy("case_id").pivot("encoder", [encoder_a, encoder_b]).agg(F.first("embedding"))
    rows = capped(wide.dropna(), largest, 0, "case_id").collect()
    x, y = (np.array([r[e] for r in rows], np.float64) for e in (encoder_a, encoder_b))

    def squared(m: np.ndarray) -> np.ndarray:
        s = (m * m).sum(1)
        return np.maximum(s[:, None] + s[None] - 2 * m @ m.T, 0)

    dx, dy = squared(x), squared(y)
    for m in (dx, dy):
        np.fill_diagonal(m, 0.0)
    if not (dx > 0).any() or not (dy > 0).any():
        return 0.0
    width = np.median(dx[dx > 0])
    k, l = np.exp(-dx / (2 * width)), np.exp(-dy / (2 * width))  # noqa: E741
    for m in (k, l):
        np.fill_diagonal(m, 0.0)
    centre = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    hsic = lambda a, b: float((centre(a) * centre(b)).sum())
    scale = hsic(k, k) * hsic(l, l)
    return hsic(k, l) / float(np.sqrt(scale)) if scale > 0 else 0.0


def metric_suite(vectors: DataFrame, encoder_a: str, encoder_b: str, ks: Sequence[int] = (5, 10, 20, 50), primary: int = 10, largest: int = 2000) -> dict[str, float | None]:
    """Every agreement metric of two encoders on the cases that both have finite vectors of.

    One neighbour graph for each encoder serves all k; linear alignment and the rotation read the
    vectors once, and RBF alignment and RSA take at most `largest` cases, the first by hash.
    """
    both = cut(finite_rows(vectors.filter(F.col("encoder").isin(encoder_a, encoder_b))).select("encoder", "case_id", "embedding"))
    shared = both.groupBy("case_id").agg(F.countDistinct("encoder").alias("n")).filter("n = 2").select("case_id")
    both = cut(both.join(shared, "case_id", "left_semi"))
    n = shared.count()
    edges = cut(knn_edges(both, max(*ks, primary)))
    lists, sums, out = neighbour_lists(edges), grams(both), {}
    sample = cut(both.join(capped(shared, largest, 0, "case_id"), "case_id", "left_semi"))
    for k in dict.fromkeys([*ks, primary]):
        r = mutual_knn(lists, k).first()
        out[f"mknn_k{k}"] = r.mknn if r else None
        out[f"cknna_k{k}"] = cknna(edges, *sorted((encoder_a, encoder_b)), n, k)
        out[f"cknna_binary_graph_k{k}"] = cknna_binary(edges.filter(F.col("rank") <= k), encoder_a, encoder_b, n, k) if n else None
    out["cka_linear"] = linear_cka(sums, encoder_a, encoder_b) if n else None
    out["cka_rbf"] = rbf_cka(sample, encoder_a, encoder_b, largest) if n else None
    out["procrustes"] = procrustes(sums, encoder_a, encoder_b) if n else None
    out["rsa_spearman"] = rsa(sample, encoder_a, encoder_b).first().spearman if n > 2 else None
    return out | {"headline_mknn": out[f"mknn_k{primary}"], "headline_cknna": out[f"cknna_k{primary}"]}


def safe_mutual_knn(vectors: DataFrame, encoder_a: str, encoder_b: str, k: int = 10, least: int = 20, largest: int = 2000, seed: int = 42) -> DataFrame:
    """(mknn, n) of the cases with finite vectors in both encoders, at most `largest` of them by hash; mknn is NULL below `least`."""
    good = finite_rows(vectors.filter(F.col("encoder").isin(encoder_a, encoder_b))).select("encoder", "case_id", "embedding")
    shared = good.groupBy("case_id").agg(F.countDistinct("encoder").alias("_n")).filter("_n = 2").select("case_id")
    chosen = cut(good.join(capped(shared, largest, seed, "case_id"), "case_id", "left_semi"))
    rows = row_overlap(neighbour_lists(knn_edges(chosen, k)), k)
    return rows.agg(F.when(F.count("*") >= least, F.avg("overlap")).alias("mknn"), F.count("*").alias("n"))


_BLOCK_SHARES = "block string, r2_alone double, r2_unique double, r2_full double, reference_mean double, reference_ci_low double, reference_ci_high double, excess double, p_value double"


def block_reference(rows: DataFrame, id_col: str, outcome: str, blocks: dict[str, Sequence[str]], replicates: int, seed: int = 0) -> DataFrame:
    """(block, r2_alone, r2_unique, r2_full, reference_mean, reference_ci_low, reference_ci_high, excess, p_value) of each block of columns.

    r2_unique is what the full model loses without the block. Its reference are replicates in which
    the rows of the block are in a random order, those of all other columns as they are. A replicate changes only the
    products of the block with the rest, which tasks give (for X.ENTRIES rows at most). Absent values of blocks
    count as 0; rows without the outcome drop out. Where the outcome does not vary, or without rows, all values are NULL.
    """
    columns = [c for cols in blocks.values() for c in cols]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kept = rows.filter(F.col(outcome).isNotNull()).select(F.col(id_col).alias("_id"), F.col(outcome).cast("double").alias("_y"), *(value(c).alias(f"_x{i}") for i, c in enumerate(columns)), F.lit(1.0).alias("_one"))
    places = X.placed_rows(kept, ["_id"], ["_y", *(f"_x{i}" for i in range(len(columns))), "_one"])
    everything = list(range(len(columns) + 2))
    at = {name: [1 + columns.index(c) for c in cols] for name, cols in blocks.items()}
    if not places.n:
        return rows.sparkSession.createDataFrame([(name, *[None] * 8) for name in blocks], _BLOCK_SHARES)
    gram, out = X.permuted_products(places, everything, everything, 0, seed)[0], []
    shares = block_r_squared(gram, 0, at)
    for name in blocks:
        own = shares[name]["unique"]
        if own is None:
            out.append((name, shares[name]["alone"], *[None] * 7))
            continue
        rest = [i for i in everything if i not in at[name]]
        draws = []
        for moved in X.permuted_products(places, rest, at[name], replicates, seed)[1:]:
            g = gram.copy()
            g[np.ix_(rest, at[name])], g[np.ix_(at[name], rest)] = moved, moved.T
            draws.append(block_r_squared(g, 0, at)[name]["unique"])
        draws = np.array(draws, float)
        low, high = np.percentile(draws, [2.5, 97.5])
        p = (int(X.at_least(draws, own).sum()) + 1) / (len(draws) + 1)
        out.append((name, shares[name]["alone"], own, shares["full"]["alone"], float(draws.mean()), float(low), float(high), own - float(draws.mean()), float(p)))
    return rows.sparkSession.createDataFrame(out, _BLOCK_SHARES)


def structural_reference(vectors: DataFrame, label: str, id_col: str, replicates: int, seed: int = 0, embedding: str = "embedding") -> DataFrame:
    """(replicate, mean_distance): mean cosine distance of the classes' centroids, first (-1) as labelled, then with the labels in random orders.

    Labels move as whole rows, so every class keeps its size. A replicate is the classes' sums of vectors,
    for X.MOST_GROUPS classes at most; rows without a label or a finite vector drop out, and with fewer than two classes there are no rows.
    """
    from concord.operators.inference import MOST_GROUPS

    rows = finite_rows(vectors.filter(F.col(label).isNotNull()), embedding)
    sizes = [r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).limit(MOST_GROUPS + 1).collect()]
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"a structure is of at most {MOST_GROUPS} classes")
    schema = "replicate int, mean_distance double"
    if len(sizes) < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    sums = X.permuted_sums(X.placed_rows(rows, [label, id_col], [embedding]), sizes, replicates, seed)
    centres = sums / np.array(sizes, float)[:, None]
    centres /= np.maximum(np.linalg.norm(centres, axis=2, keepdims=True), 1e-9)
    i, j = np.triu_indices(len(sizes), 1)
    distances = [float((1 - (c[i] * c[j]).sum(1)).mean()) for c in centres]
    return vectors.sparkSession.createDataFrame([(b - 1, x) for b, x in enumerate(distances)], schema)


def top_singular_share(gram: np.ndarray) -> float:
    """Share of the largest squared singular value in all, from a Gram matrix with the extra component."""
    values = np.linalg.eigvalsh(gram[:-1, :-1])
    return float(values[-1] / values.sum())


def consensus_state(done: int, expected: int, converged: bool) -> str:
    """pending until every encoder is there, then ready, or not_converged."""
    return "pending" if done < expected else "ready" if converged else "not_converged"


def usable_encoders(vectors: DataFrame, cases: DataFrame, lost_encoders: float = 0.25, lost_cases: float = 0.2) -> DataFrame:
    """Finite vectors of the cases that every kept encoder has.

    Encoders that lack more than lost_cases of the cases go first; the query fails if more than
    lost_encoders of the encoders or lost_cases of the cases would be lost.
    """
    from concord.operators.relational import in_all
    from concord.operators.vectors import finite_rows

    rows = finite_rows(vectors).join(cases.select("case_id").distinct(), "case_id", "left_semi")
    n_cases, n_encoders = cases.select("case_id").distinct().count(), vectors.select("encoder").distinct().count()
    kept = rows.groupBy("encoder").agg(F.countDistinct("case_id").alias("n")).filter(F.col("n") >= (1 - lost_cases) * n_cases)
    names = [r.encoder for r in kept.collect()]
    if len(names) < (1 - lost_encoders) * n_encoders:
        raise ValueError(f"{len(names)} of {n_encoders} encoders have enough finite vectors")
    rows = rows.filter(F.col("encoder").isin(*names))
    shared = in_all(rows, "case_id", "encoder")
    if shared.count() < (1 - lost_cases) * n_cases:
        raise ValueError("too few cases have a finite vector of every encoder")
    return rows.join(shared, "case_id", "left_semi")
