"""The compositions: pools, splits, agreement maps, fits, ladders, contrasts, studies.

Each takes tables and returns tables; nothing is written, and every part is an operator of the
library. Panels, pairs of encoders and findings are few; cases are many.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.functions import numbers as N
from concord.functions import text as X
from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import probes as P
from concord.operators import relational as R
from concord.operators import resampling as Y
from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.operators.order import positions
from concord.sources.shared import cut
from concord.sources.tables import with_files

CORE = {"case_id": "string", "dataset": "string", "modality": "string", "split": "string", "image_key": "string", "image_subdir": "string"}


def build_pool(masters: dict[str, DataFrame], policies: DataFrame, views: dict, findings: Sequence[str], cap: int = 0, seed: int = 0, files: DataFrame | None = None) -> DataFrame:
    """One manifest of all sites: view filter, cap, decoded findings, existing images, unique case ids.

    A master has image_key, view, split, image_subdir, subject columns and its native label columns.
    """
    parts = []
    for site, master in masters.items():
        rows = R.keep_views(master.withColumn("dataset", F.lit(site)), "dataset", "view", views)
        if cap > 0:
            rows = S.capped(rows, cap, seed, "image_key")
        rows = rows.withColumn("case_id", X.case_id(F.lit(site), F.col("image_key"))).withColumn("modality", F.lit("cxr")).withColumn("split", L.split_name(F.col("split")))
        native = [r.native for r in policies.filter(F.col("site") == site).select("native").distinct().collect() if r.native in rows.columns]
        if native:
            long = rows.unpivot(["case_id", "dataset"], [F.col(c).cast("string").alias(c) for c in native], "native", "code").withColumnRenamed("dataset", "site")
            wide = L.decode_by_policy(long, policies).groupBy("case_id").pivot("finding", list(findings)).agg(F.max("value"))
            rows = rows.drop(*native).join(wide, "case_id", "left")
        parts.append(rows)
    pool = R.conform(R.union_all(*parts), CORE)
    return with_files(pool, files, "image_path") if files is not None else pool


def case_splits(pool: DataFrame, external: Sequence[str]) -> DataFrame:
    """(case_id, dataset, split, subject_id, role): external sites, then development for train, then internal_test."""
    role = F.when(F.col("dataset").isin(*external), "external").when(F.col("split") == "train", "development").otherwise("internal_test")
    return pool.select("case_id", "dataset", "split", "subject_id", role.alias("role"))


def pairwise_map(vectors: DataFrame, k_ladder: Sequence[int], n: int | None = None, seed: int = 0, replicates: int = 0, floor: Sequence[str] = ()) -> DataFrame:
    """(encoder_a, encoder_b, metric, value, n, comparison_type) for every pair, one neighbour graph per encoder.

    With n, the same n cases are drawn for all encoders. With replicates, value_std, value_ci_low and
    value_ci_high come from subsamples of 0.632 of the cases, the same ones for all pairs, without a row for each replicate.
    """
    if n:
        vectors = vectors.join(S.capped(vectors.select("case_id").distinct(), n, seed, "case_id"), "case_id", "left_semi")
    lists, out = cut(V.neighbour_lists(V.knn_edges(V.finite_rows(vectors), max(k_ladder)))), None
    kind = F.when(F.col("encoder_a").isin(*floor) | F.col("encoder_b").isin(*floor), "floor").otherwise("within") if floor else F.lit("within")
    for k in k_ladder:
        rows = A.row_overlap(lists, k)
        one = rows.groupBy("encoder_a", "encoder_b").agg(F.avg("overlap").alias("value"), F.count("*").alias("n"))
        if replicates:
            one = one.join(_subsample_spread(rows, replicates, seed), ["encoder_a", "encoder_b"])
        one = one.select("encoder_a", "encoder_b", F.lit(f"mknn_k{k}").alias("metric"), "value", "n", kind.alias("comparison_type"), *(c for c in one.columns if c.startswith("value_")))
        out = one if out is None else out.unionByName(one)
    return out


def _subsample_spread(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(encoder_a, encoder_b, value_std, value_ci_low, value_ci_high) of the mean overlap of each pair of a panel over subsamples of the cases."""
    names = sorted(tuple(r) for r in rows.select("encoder_a", "encoder_b").distinct().collect())
    by_pair = rows.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("encoder_a", "encoder_b"), "overlap"))).alias("m"))
    of = [F.try_element_at("m", F.struct(F.lit(a).alias("encoder_a"), F.lit(b).alias("encoder_b"))) for a, b in names]
    wide = by_pair.select("case_id", F.array(*(F.coalesce(x, F.lit(0.0)) for x in of), *(x.isNotNull().cast("double") for x in of)).alias("x"))
    places = Y.placed_rows(wide, ["case_id"], ["x"])
    sums = Y.permuted_sums(places, [max(1, round(0.632 * places.n))], replicates, seed)[1:, 0]
    schema = "encoder_a string, encoder_b string, value_std double, value_ci_low double, value_ci_high double"
    found = [(*pair, *I.spread_of(I.ratio(sums[:, i], sums[:, len(names) + i]))[:3]) for i, pair in enumerate(names)]
    return rows.sparkSession.createDataFrame(found, schema)


def map_summary(pairs: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """By metric: mean of each comparison type, permutation p of within against the rest, false-discovery control."""
    out = None
    for metric in [r.metric for r in pairs.select("metric").distinct().orderBy("metric").collect()]:
        rows = pairs.filter(F.col("metric") == metric)
        one = I.permutation_two(rows, "value", "comparison_type", "within", ["encoder_a", "encoder_b"], replicates, seed).select(F.lit(metric).alias("metric"), "difference", "n_a", "n_b", F.col("p_value").alias("p_raw"))
        out = one if out is None else out.unionByName(one)
    return I.benjamini_hochberg(out, "p_raw")


def cross_map(vectors: DataFrame, one_side: Sequence[str], other_side: Sequence[str], k: int) -> DataFrame:
    """Agreement of every encoder of one side (images, say) with every one of the other (texts)."""
    lists = V.neighbour_lists(V.knn_edges(V.finite_rows(vectors), k))
    a = lists.filter(F.col("encoder").isin(*one_side)).select(F.col("encoder").alias("encoder_a"), "case_id", F.col("neighbours").alias("na"))
    b = lists.filter(F.col("encoder").isin(*other_side)).select(F.col("encoder").alias("encoder_b"), "case_id", F.col("neighbours").alias("nb"))
    share = F.size(F.array_intersect("na", "nb")) / float(k)
    return a.join(b, "case_id").groupBy("encoder_a", "encoder_b").agg(F.avg(share).alias("value"), F.count("*").alias("n"))


def ontology_link(vectors: DataFrame, group: str, distances: DataFrame, replicates: int = 200, seed: int = 0, least: int = 20) -> DataFrame:
    """Mantel test of class-centroid distances against a reference distance (finding_a, finding_b, d) of the same classes."""
    centres = V.centroids(vectors, group, least=least)
    manifold = V.centroid_distances(centres, group).filter("a < b")
    lo, hi = F.least("finding_a", "finding_b"), F.greatest("finding_a", "finding_b")
    other = distances.select(lo.alias("a"), hi.alias("b"), F.col("d").alias("y")).dropDuplicates(["a", "b"])
    both = manifold.withColumnRenamed("distance", "x").join(other, ["a", "b"])
    return I.mantel(both, "a", "b", "x", "y", centres.select(group), replicates, seed)


def scaling_fits(encoders: DataFrame, outcomes: Sequence[str], axes: Sequence[str], logarithmic: Sequence[str] = ()) -> DataFrame:
    """(outcome, axis, slope, intercept, r_squared, n, spearman) over a table of one row per encoder; some axes in log10."""
    out = None
    for y in outcomes:
        for x in axes:
            rows = encoders.select((N.log10_positive(F.col(x)) if x in logarithmic else F.col(x).cast("double")).alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
            one = I.slope(rows, "x", "y").crossJoin(I.spearman(rows, "x", "y").select("spearman")).select(F.lit(y).alias("outcome"), F.lit(x).alias("axis"), "*")  # one row each
            out = one if out is None else out.unionByName(one)
    return out.filter("n >= 4")


def agreement_of_draws(vectors: DataFrame, drawn: DataFrame, k: int) -> DataFrame:
    """(finding, encoder_a, encoder_b, mknn, n): agreement of every two encoders among the cases of each draw (case_id, finding). No vector is copied for a draw."""
    return _agreement(V.knn_edges_of_draws(vectors, drawn, k, "finding"), k)


def _agreement(edges: DataFrame, k: int) -> DataFrame:
    """(finding, encoder_a, encoder_b, mknn, n) of the edges of draws."""
    lists = edges.groupBy("finding", "encoder", F.col("src").alias("case_id")).agg(F.collect_list("dst").alias("neighbours"))  # k at most
    a = lists.select("finding", F.col("encoder").alias("encoder_a"), "case_id", F.col("neighbours").alias("na"))
    b = lists.select("finding", F.col("encoder").alias("encoder_b"), "case_id", F.col("neighbours").alias("nb"))
    share = F.size(F.array_intersect("na", "nb")) / float(k)
    return a.join(b, ["finding", "case_id"]).filter("encoder_a < encoder_b").groupBy("finding", "encoder_a", "encoder_b").agg(F.avg(share).alias("mknn"), F.count("*").alias("n"))


def finding_agreement(vectors: DataFrame, positives: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """(finding, encoder_a, encoder_b, mknn, n): agreement on the same number n of positive cases of each finding.

    positives holds (case_id, finding); findings with fewer than n cases drop out.
    """
    drawn = S.matched_draw(positives.withColumn("_key", F.concat_ws("|", "finding", "case_id")), "finding", n, seed, "_key")
    return agreement_of_draws(vectors, drawn, k)


def demographic_agreement(vectors: DataFrame, cases: DataFrame, attributes: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """(attribute, level, encoder_a, encoder_b, mknn, n) on draws of equal size from the levels of each attribute; cases has case_id and the attributes."""
    drawn = S.subgroup_draws(cases, attributes, seed, "case_id").select("case_id", F.concat_ws("|", "attribute", "level").alias("finding"))
    found = agreement_of_draws(vectors, drawn, k)
    name = F.substring_index("finding", "|", 1)
    return found.select(name.alias("attribute"), F.expr("substr(finding, length(substring_index(finding, '|', 1)) + 2)").alias("level"), "encoder_a", "encoder_b", "mknn", "n")


def demographic_tests(agreement: DataFrame, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """For each attribute: range of the levels' means with its reference, and the p of a permutation F, each adjusted over attributes."""
    out, rows = None, cut(agreement.withColumn("pair", F.concat_ws("|", "encoder_a", "encoder_b")))
    for attribute in [r[0] for r in rows.select("attribute").distinct().orderBy("attribute").collect()]:
        own = rows.filter(F.col("attribute") == attribute)
        full = own.join(R.in_all(own, "pair", "level"), "pair", "left_semi")
        one = I.range_reference(full, "pair", "level", "mknn", replicates, seed).crossJoin(I.permutation_groups(full, "mknn", "level", ["pair"], replicates, seed).select("f", F.col("p_value").alias("p_groups")))  # one row each
        one = one.select(F.lit(attribute).alias("attribute"), "*")
        out = one if out is None else out.unionByName(one)
    return I.benjamini_hochberg(out, "p_reference", out="p_reference_fdr").drop("significant_fdr05").transform(lambda t: I.benjamini_hochberg(t, "p_groups", out="p_groups_fdr"))


def gold_agreement(vectors: DataFrame, gold: DataFrame, k: int = 10, least: int = 20, largest: int = 2000, seed: int = 42) -> DataFrame:
    """(finding, gold_alignment, n_pairs): mean agreement over encoder pairs on expert-labelled cases (case_id, finding), at most `largest` of each finding by hash."""
    cases = S.cap_per_group(gold.select("case_id", "finding").distinct(), "finding", largest, seed, "case_id")
    pairs = agreement_of_draws(V.finite_rows(vectors), cases, k).filter(F.col("n") >= least)
    return pairs.groupBy("finding").agg(F.avg("mknn").alias("gold_alignment"), F.count("*").alias("n_pairs"))


def grade_ladder(vectors: DataFrame, grades: DataFrame, healthy: int = 50, graded: int = 200) -> DataFrame | None:
    """Per encoder: rank correlation of the distance from the healthy centroid with the grade; None below the counts."""
    rows = vectors.join(grades, "case_id")
    counts = grades.agg(F.count_if(F.col("grade") == 0).alias("h"), F.count_if(F.col("grade") >= 1).alias("g"), F.countDistinct(F.when(F.col("grade") >= 1, F.col("grade"))).alias("k")).first()
    if counts.h < healthy or counts.g < graded or counts.k < 3:
        return None
    out = None
    for e in [r.encoder for r in vectors.select("encoder").distinct().orderBy("encoder").collect()]:
        own = rows.filter(F.col("encoder") == e)
        far = V.distance_from(own.filter("grade >= 1"), V.centroids(own.filter("grade = 0"), "grade"))
        one = I.spearman(far.select("grade", "distance"), "grade", "distance").select(F.lit(e).alias("encoder"), "spearman", "n")
        out = one if out is None else out.unionByName(one)
    return out


def within_group_draws(vectors: DataFrame, cases: DataFrame, group: str, n: int, k: int, seed: int = 0) -> DataFrame:
    """Agreement within each group at n cases, beside as many draws of n from all cases: (draw, arm, encoder_a, encoder_b, mknn)."""
    inside = S.matched_draw(cases, group, n, seed, "case_id").select("case_id", F.concat(F.lit("within:"), F.col(group).cast("string")).alias("finding"))
    names = [r.finding for r in inside.select("finding").distinct().collect()]
    out = inside
    for i in range(len(names)):
        out = out.unionByName(S.capped(cases.select("case_id"), n, f"{seed}:{i}", "case_id").withColumn("finding", F.lit(f"random:{i}")))
    pairs = finding_agreement(vectors, out, n, k, seed)
    return pairs.select(F.col("finding").alias("draw"), F.split("finding", ":")[0].alias("arm"), "encoder_a", "encoder_b", "mknn")


def acquisition_arm(vectors: DataFrame, cases: DataFrame, maker: str, n: int, k: int, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """For every two encoders: agreement within makers against as many draws from all cases, with its permutation p.

    (encoder_a, encoder_b, test, n_manufacturers, manufacturers, matched_n, k, difference, within_mean, across_mean, p_raw); no rows with
    fewer than two makers of n cases.
    """
    pairs = cut(within_group_draws(vectors, cases, maker, n, k, seed))
    out = None
    for a, b in sorted(tuple(r) for r in pairs.select("encoder_a", "encoder_b").distinct().collect()):
        own = pairs.filter((F.col("encoder_a") == a) & (F.col("encoder_b") == b))
        makers = sorted(r.draw.split(":", 1)[1] for r in own.filter("arm = 'within'").select("draw").collect())
        if len(makers) < 2:
            continue
        found = I.two_group_report(own, "mknn", "arm", "within", ["draw"], "d", share=False, tested="within_manufacturer", replicates=replicates, seed=seed).first()
        row = (a, b, "acquisition", len(makers), ";".join(makers), n, k, found.d_mean_raw, own.filter("arm = 'within'").agg(F.avg("mknn")).first()[0], own.filter("arm = 'random'").agg(F.avg("mknn")).first()[0], found.p_raw)
        out = [row] if out is None else [*out, row]
    return vectors.sparkSession.createDataFrame(out or [], "encoder_a string, encoder_b string, test string, n_manufacturers int, manufacturers string, matched_n int, k int, difference double, within_mean double, across_mean double, p_raw double")


def preprocessing_arm(native: DataFrame, harmonised: DataFrame, n: int, k: int, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """For every two encoders: agreement of harmonised vectors against that of native ones on the same draws of n cases, with a bootstrap of the paired difference.

    (encoder_a, encoder_b, test, n_draws, native_mean, harmonized_mean, difference, ci_low, ci_high, p_value, matched_n, k). Draws are of the cases that all encoders have both ways, as many as
    n goes into them, four at least; no rows if they are fewer than n.
    """
    both = V.finite_rows(native).select(F.concat(F.lit("native|"), "encoder").alias("encoder"), "case_id", "embedding").unionByName(V.finite_rows(harmonised).select(F.concat(F.lit("harmonized|"), "encoder").alias("encoder"), "case_id", "embedding"))
    both = cut(both)
    shared = cut(R.in_all(both, "case_id", "encoder"))
    schema = "encoder_a string, encoder_b string, test string, n_draws long, native_mean double, harmonized_mean double, difference double, ci_low double, ci_high double, p_value double, matched_n int, k int"
    count = shared.count()
    if count < n:
        return native.sparkSession.createDataFrame([], schema)
    drawn = S.capped_draws(shared, n, max(4, count // n), seed, "case_id").select("case_id", F.concat(F.lit("draw "), F.col("i").cast("string")).alias("finding"))
    found = _agreement(V.knn_edges_of_small_draws(both, drawn, k, "finding"), k)
    way = lambda c, i: F.split(c, r"\|")[i]
    found = found.filter(way("encoder_a", 0) == way("encoder_b", 0)).select("finding", way("encoder_a", 1).alias("a"), way("encoder_b", 1).alias("b"), way("encoder_a", 0).alias("way"), "mknn")
    found = cut(found.groupBy("finding", "a", "b").pivot("way", ["native", "harmonized"]).agg(F.first("mknn")))
    out = []
    for a, b in sorted(tuple(r) for r in found.select("a", "b").distinct().collect()):
        own = found.filter((F.col("a") == a) & (F.col("b") == b))
        r = I.paired_bootstrap(own, "harmonized", "native", replicates, seed).first()
        m = own.agg(F.avg("native"), F.avg("harmonized")).first()
        out.append((a, b, "preprocessing", r.n, m[0], m[1], r.point, r.ci_low, r.ci_high, r.p_value, n, k))
    return native.sparkSession.createDataFrame(out, schema)


def exposure_arm(vectors: DataFrame, cases: DataFrame, pool: str, n: int, k: int, unseen: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(encoder_a, encoder_b, pool, test, alignment, panel_saw_this_site, matched_n, k): agreement on n cases of the pool and of each of its sites.

    cases holds (case_id, site). A site with fewer than n cases has no row; unseen names the pools that no encoder was trained on.
    """
    keyed = cases.select("case_id", F.concat(F.lit(f"{pool}:"), F.col("site").cast("string")).alias("tag")).filter("tag IS NOT NULL").unionByName(cases.select("case_id", F.lit(pool).alias("tag"))).distinct()
    drawn = S.matched_draw(keyed.withColumn("_key", F.concat_ws("|", "tag", "case_id")), "tag", n, seed, "_key").select("case_id", F.col("tag").alias("finding"))
    found = agreement_of_draws(V.finite_rows(vectors), drawn, k)
    base = F.replace(F.split("finding", ":")[0], F.lit("_pool"), F.lit(""))
    return found.select("encoder_a", "encoder_b", F.col("finding").alias("pool"), F.lit("pretraining_exposure").alias("test"), F.col("mknn").alias("alignment"), ~base.isin(*unseen) if unseen else F.lit(True).alias("panel_saw_this_site"), F.lit(n).alias("matched_n"), F.lit(k).alias("k")).toDF("encoder_a", "encoder_b", "pool", "test", "alignment", "panel_saw_this_site", "matched_n", "k")


def arm_contrasts(pairs: DataFrame, value: str, group: str, baseline: str) -> DataFrame:
    """Mean of every group of run pairs and its difference from a baseline group, with jackknife over runs."""
    out = None
    for g in [r[0] for r in pairs.select(group).distinct().orderBy(group).collect() if r[0] != baseline]:
        one = I.contrast(pairs, "run_id_a", "run_id_b", value, group, g, baseline).select(F.lit(g).alias("group"), F.lit(baseline).alias("baseline"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def training_mixture(pool: DataFrame, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows of whole subjects from each dataset until its number is reached, for a mixture of datasets."""
    out = None
    for dataset, n in shares.items():
        one = S.take_until(pool.filter(F.col("dataset") == dataset), "subject_id", n, seed)
        out = one if out is None else out.unionByName(one)
    return out


def reader_study(first: DataFrame, second: DataFrame, truth: DataFrame, answer: str = "finding_present") -> DataFrame:
    """One row: each reader's accuracy, sensitivity and specificity against the label, and their kappa on shared cases.

    Readers have (display_id, answer) and truth (display_id, case_id, label).
    """
    reads = []
    for name, df in (("a", first), ("b", second)):
        said = df.join(truth, "display_id").select("case_id", "label", L.yes_no(F.col(answer)).alias("yes")).filter("yes >= 0")
        right = lambda c: F.avg(F.when(c, (F.col("yes") == F.col("label")).cast("double")))
        reads.append((name, said, said.agg(right(F.lit(True)).alias(f"accuracy_{name}"), right(F.col("label") == 1).alias(f"sensitivity_{name}"), right(F.col("label") == 0).alias(f"specificity_{name}"), F.count("*").alias(f"n_{name}"))))
    both = reads[0][1].select("case_id", F.col("yes").alias("x")).join(reads[1][1].select("case_id", F.col("yes").alias("y")), "case_id")
    return reads[0][2].crossJoin(reads[1][2]).crossJoin(I.kappa(both, "x", "y"))  # one row each


def dosed_views(vectors: DataFrame, doses: Sequence[float], seed: int = 0) -> DataFrame:
    """The planted-effect control: for each dose a vector of own noise mixed with the case's, as encoders clean and dose_x.

    At dose 0 agreement with `clean` is at chance, and it must rise with the dose. Noise comes from hashes.
    """

    def noise(d: float) -> Column:
        unit = lambda i: (F.pmod(S.hash_number(f"{seed}:{d}", F.col("case_id"), i), F.lit(1 << 30)) / float(1 << 30) - 0.5) * 3.4641
        return F.transform(F.sequence(F.lit(1), F.size("embedding")), unit)

    clean = vectors.withColumn("encoder", F.lit("clean")).repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    out = clean
    for d in doses:
        scale = F.sqrt(F.size("embedding").cast("double"))
        mixed = F.zip_with(F.transform("embedding", lambda x: x * scale), noise(d), lambda x, e: d * x + (1 - d) * e)
        out = out.unionByName(clean.withColumn("encoder", F.lit(f"dose_{d}")).withColumn("embedding", V.normalised(mixed)))
    return cut(out)  # the hashes are made once


def width_control(encoders: DataFrame) -> DataFrame:
    """(analysis, control, n_encoders, rho) of agreement with size and year, plain and with the width held: encoders has alignment, log_params, year, log_width."""
    rows = encoders.filter(F.col("alignment").isNotNull() & F.col("log_width").isNotNull())
    enough = rows.select("log_width").distinct().count() >= 3
    plain = [("alignment_vs_log_width", "log_width", "alignment"), ("log_params_vs_log_width", "log_width", "log_params")]
    held = [("alignment_vs_log_params_given_width", "log_params"), ("alignment_vs_year_given_width", "year")]
    out = None
    for name, x, y in plain:
        one = I.spearman(rows, x, y).select(F.lit(name).alias("analysis"), F.lit("none").alias("control"), F.col("n").alias("n_encoders"), F.col("spearman").alias("rho"))
        out = one if out is None else out.unionByName(one)
    for name, x in held:
        one = I.partial_spearman(rows, x, "alignment", "log_width").select(F.lit(name).alias("analysis"), F.lit("log10(embedding_width)").alias("control"), F.col("n").alias("n_encoders"), F.when(F.lit(enough), F.col("partial_spearman")).alias("rho"))
        out = out.unionByName(one)
    return out


LINK = ["route", "level", "metric", "n_anchors", "objective_pair", "outcome"]


def link_rows(alignment: DataFrame, retention: DataFrame, primary_metric: str) -> DataFrame:
    """(route, level, metric, n_anchors, objective_pair, outcome, pair_lo, pair_hi, x, y): agreement beside each outcome of the same pair.

    alignment has (metric, pair_lo, pair_hi, alignment), retention (route, n_anchors, pair_lo, pair_hi,
    objective_pair, retention, chance_corrected). The primary metric also stands by objective pair.
    """
    both = alignment.join(retention, ["pair_lo", "pair_hi"]).unpivot(["route", "metric", "n_anchors", "objective_pair", "pair_lo", "pair_hi", "alignment"], ["retention", "chance_corrected"], "outcome", "y")
    both = both.withColumnRenamed("alignment", "x").filter("x IS NOT NULL AND y IS NOT NULL")
    every = both.withColumn("objective_pair", F.lit(None).cast("string")).withColumn("level", F.lit("all_pairs"))
    each = both.filter((F.col("metric") == primary_metric) & F.col("objective_pair").isNotNull()).withColumn("level", F.lit("objective_pair"))
    return every.unionByName(each).select(*LINK, "pair_lo", "pair_hi", "x", "y")


def link_statistics(rows: DataFrame, least: int = 10, least_left: int = 4) -> DataFrame:
    """For each group of link rows with enough pairs: rank correlation with its error by leaving out one unit at a time, slope and R²."""
    rows = cut(rows.fillna({"objective_pair": "", "n_anchors": 0}))
    sizes = rows.groupBy(*LINK).agg(F.count("*").alias("n_pairs"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r_squared")).filter(F.col("n_pairs") >= least)
    units = rows.select(*LINK, F.col("pair_lo").alias("unit")).union(rows.select(*LINK, "pair_hi")).distinct()
    kept = rows.join(units, LINK).filter((F.col("pair_lo") != F.col("unit")) & (F.col("pair_hi") != F.col("unit")))  # pair tables by their few units
    left = I.spearman(kept, "x", "y", [*LINK, "unit"]).filter((F.col("n") >= least_left) & F.col("spearman").isNotNull())
    g = F.count("*")
    error = left.groupBy(*LINK).agg(F.when(g >= 3, F.sqrt((g - 1) / g * F.var_pop("spearman") * g)).alias("std"), g.alias("n_units"))
    return I.spearman(rows, "x", "y", LINK).drop("n").withColumnRenamed("spearman", "rho").join(sizes, LINK).join(error, LINK, "left")


def link_table(alignment: DataFrame, retention: DataFrame, primary: tuple[str, str, int], least: int = 10) -> DataFrame:
    """link_statistics() with p, adjusted p and the decision: whether the one pre-specified row (route, metric, budget) shows that agreement predicts retention.

    It does if its adjusted p, or p where there is none, lies below 0.05 and correlation and R² are positive. Without that one row it fails.
    """
    route, metric, budget = primary
    stats = link_statistics(link_rows(alignment, retention, metric), least)
    found = stats.collect()  # a row for each metric, route, budget and outcome
    rows = [(*(r[c] for c in LINK), r.rho, r.slope, r.r_squared, r.n_pairs, r["std"], r.n_units, I.normal_p(r.rho, r["std"])) for r in found]
    kinds = "route string, level string, metric string, n_anchors int, objective_pair string, outcome string, rho double, slope double, r_squared double, n_pairs long, std double, n_units long, p_raw double"
    out = I.benjamini_hochberg(alignment.sparkSession.createDataFrame(rows, kinds), "p_raw", ["route", "level", "metric", "outcome"])
    main = (F.col("route") == route) & (F.col("level") == "all_pairs") & (F.col("metric") == metric) & (F.col("n_anchors") == budget) & (F.col("outcome") == "retention")
    if sum((r.route, r.level, r.metric, r.n_anchors, r.outcome) == (route, "all_pairs", metric, budget, "retention") for r in found) != 1:
        raise ValueError("the pre-specified row of the link is not there once")
    meets = main & (F.coalesce("p_fdr", "p_raw") < 0.05) & (F.col("rho") > 0) & (F.col("r_squared") > 0)
    return out.withColumn("role", F.when(main, "primary").otherwise("")).withColumn("meets_rule", F.coalesce(meets, F.lit(False)))


def class_pool(master: DataFrame, dataset: str, id_col: str, classes: dict[str, str], cap: int, seed: int = 0, subdir: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Manifest of a collection with one column for each class: at most cap cases of a class, which is that of the largest column, the first of equals.

    classes maps native columns to the names they get. With files, a table with `path`, cases without an image drop out first.
    """
    rows = master.withColumn("image_key", F.col(id_col).cast("string")).withColumn("_class", L.argmax_class([F.col(c).cast("double") for c in classes], list(classes)))
    if files is not None:
        rows = with_files(rows.withColumn("_path", F.concat_ws("/", F.lit(subdir), "image_key")), files, "_path").drop("_path")
    rows = S.cap_per_group(rows, "_class", cap, seed, "image_key")
    return rows.select(
        F.concat_ws("__", F.lit(dataset.replace("_", "__", 1)), "image_key").alias("case_id"), F.lit(dataset).alias("dataset"), F.lit(dataset.split("_")[0]).alias("modality"), F.lit("train").alias("split"), "image_key",
        F.lit(subdir).cast("string").alias("image_subdir"), *(F.col(c).cast("double").alias(n) for c, n in classes.items()),
    )


def graded_pool(master: DataFrame, dataset: str, labels: dict[str, str], sides: Sequence[str], grades: Sequence[str], rater: str, cap: int = 0, seed: int = 0) -> DataFrame:
    """Manifest of a collection with graded and side-resolved findings, cut to about cap rows by whole subjects within each split.

    master has image_id, img_rel_path, subject_id, split, age, gender, view, study_date and the rater's
    column. Labels are 1 or 0, anything else is NULL; a grade that is no number is NULL.
    """
    yes = lambda c: L.decode_codes(F.col(c), 1.0, [0.0])
    there = set(master.columns)
    pool = master.select(
        F.concat(F.lit(f"{dataset}__"), F.col("image_id").cast("string")).alias("case_id"), F.lit(dataset).alias("dataset"), F.lit("cxr").alias("modality"), "image_id", F.col("img_rel_path").alias("image_key"), "subject_id",
        F.col(rater).alias("reader_id"), L.split_name(F.col("split")).alias("split"), "age", F.col("gender").alias("sex"), "view", "study_date",
        *(yes(native).alias(name) for native, name in labels.items()),
        *(yes(f"{f}_{side}_binary").alias(f"side__{f}__{side}") for f in sides for side in ("right", "left") if f"{f}_{side}_binary" in there),
        *(F.expr(f"try_cast(`{g}` AS double)").alias(f"grade__{g}") for g in grades if g in there),
    )
    if not cap:
        return pool
    pool = cut(pool)
    sizes = {r.split: r.n for r in pool.groupBy("split").agg(F.count("*").alias("n")).collect()}
    total, parts = sum(sizes.values()), []
    if total <= cap:
        return pool
    for split, n in sizes.items():
        parts.append(S.take_fitting(pool.filter(F.col("split").eqNullSafe(F.lit(split))), "subject_id", round(cap * n / total), seed, "dataset"))
    return R.union_all(*parts)


REPORT = ["case_id", "dataset", "image_key", "split", "report_path", "report_text", "report_source"]


def paired_reports(pool: DataFrame, plus: DataFrame, sections: Sequence[str], root: str = "", files: DataFrame | None = None, file_site: str = "mimic", section_site: str = "chexpert", key: str = "image_key") -> DataFrame:
    """Cases of a pool with their reports: the path of a file at one site, the joined sections of a table at the other.

    A file report counts if its path is given and, with files, there. Of a section report the non-blank
    sections are joined, else its `report` stands for it; a case without either drops out, and so do
    further rows of plus with the same key.
    """
    blank = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none")
    told = pool.filter((F.col("dataset") == file_site) & ~blank(F.col("report_rel_path")))
    told = told.withColumn("report_path", F.concat_ws("/", F.lit(root) if root else F.lit(None).cast("string"), "report_rel_path"))
    if files is not None:
        told = with_files(told, files, "report_path")
    told = told.withColumn("report_text", F.lit(None).cast("string")).withColumn("report_source", F.lit(f"{file_site}_report_file"))
    first = R.first_per_key(plus, [key], [*sections, "report"])
    cleaned = [F.when(~blank(F.col(c)), F.trim(c)) for c in sections]
    joined = F.concat_ws("\n", *cleaned)
    fallback = F.when(~blank(F.col("report")), F.trim("report"))
    said = pool.filter(F.col("dataset") == section_site).select("case_id", "dataset", F.col("image_key").alias("_key"), "split").join(first.withColumnRenamed(key, "_key"), "_key")
    said = said.withColumn("report_text", F.when(joined != "", joined).otherwise(fallback)).filter("report_text IS NOT NULL")
    said = said.withColumn("report_source", F.when(joined != "", "+".join(sections)).otherwise("report")).withColumn("image_key", F.col("_key")).withColumn("report_path", F.lit(None).cast("string"))
    return told.select(*REPORT).unionByName(said.select(*REPORT))


def referenced(draws: DataFrame, value: str, own: float | None) -> DataFrame:
    """(value, reference_mean, reference_ci_low, reference_ci_high, excess, p_value) of one number against its replicates; no row without replicates."""
    reached = F.col(value) >= F.lit(own) - 1e-9 * F.abs(F.lit(own))
    p = (F.sum(reached.cast("long")) + 1) / (F.count(value) + 1.0)
    out = draws.agg(F.lit(own).cast("double").alias("_own"), F.avg(value).alias("reference_mean"), F.percentile(value, 0.025).alias("reference_ci_low"), F.percentile(value, 0.975).alias("reference_ci_high"), (F.lit(own) - F.avg(value)).alias("excess"), p.alias("p_value"), F.count(value).alias("_n"))
    return out.filter("_n > 0").withColumnRenamed("_own", value).drop("_n")


RUN = ["arm", "level", "backbone", "init", "seed"]


def run_pairs(pairs: DataFrame, value: str = "mknn") -> DataFrame:
    """Pairs of runs (run_id_a, run_id_b, experiment, value) with the parts of both run ids and the value as `v`; pairs without a value drop out."""
    parts = [p.alias(f"{n}_{s}") for s in "ab" for n, p in zip(RUN, X.key_parts(F.col(f"run_id_{s}"), RUN))]
    return pairs.select("run_id_a", "run_id_b", "experiment", F.col(value).cast("double").alias("v"), *parts).filter("v IS NOT NULL")


def _contrasted(rows: DataFrame, contrasts: Sequence[tuple[str | Column, Column, Column]]) -> DataFrame:
    """(contrast, setting, run_id_a, run_id_b, v): a row for each contrast (name, setting, condition) that a pair is part of."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    each = F.array(*(F.when(c, F.struct(text(name).alias("contrast"), text(setting).alias("setting"))) for name, setting, c in contrasts))
    return rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c"), "run_id_a", "run_id_b", "v").select("c.*", "run_id_a", "run_id_b", "v")


def _by_runs(rows: DataFrame, by: Sequence[str], statistic: Column, least: int = 4, least_left: int = 2) -> DataFrame:
    """(by..., std, n_units): error of a statistic of each group of pairs by leaving out one run at a time; NULL below four pairs or three runs."""
    units = rows.select(*by, F.col("run_id_a").alias("unit")).union(rows.select(*by, "run_id_b")).distinct()
    kept = rows.join(units, list(by)).filter((F.col("run_id_a") != F.col("unit")) & (F.col("run_id_b") != F.col("unit")))  # pair tables by their few runs
    left = kept.groupBy(*by, "unit").agg(statistic.alias("s"), F.count("*").alias("n")).filter((F.col("n") >= least_left) & F.col("s").isNotNull())
    g = F.count("*")
    error = left.groupBy(*by).agg(F.when(g >= 3, F.sqrt((g - 1) * F.var_pop("s"))).alias("std"), g.alias("n_units"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return sizes.join(error, list(by), "left").select(*by, F.when(F.col("_n") >= least, F.col("std")).alias("std"), F.coalesce("n_units", F.lit(0)).alias("n_units"))


def contrast_rows(long: DataFrame) -> DataFrame:
    """Of each contrast and setting: (alignment, n_pairs, n_cells, min_raw, max_raw, crossed_std, crossed_ci_low, crossed_ci_high, crossed_n_cells)."""
    long, by = cut(long), ["contrast", "setting"]
    runs = long.select(*by, F.explode(F.array("run_id_a", "run_id_b")).alias("run")).groupBy(*by).agg(F.countDistinct("run").alias("n_cells"))
    per = long.groupBy(*by).agg(F.avg("v").alias("alignment"), F.count("*").alias("n_pairs"), F.min("v").alias("min_raw"), F.max("v").alias("max_raw"))
    out = per.join(runs, by).join(_by_runs(long, by, F.avg("v")), by)
    m, e = F.col("alignment"), F.col("std")
    return out.select(*by, "alignment", "n_pairs", "n_cells", "min_raw", "max_raw", e.alias("crossed_std"), (m - 1.96 * e).alias("crossed_ci_low"), (m + 1.96 * e).alias("crossed_ci_high"), F.col("n_units").alias("crossed_n_cells"))


def initialization_pairs(rows: DataFrame, backbone: str = "vit_s", experiment: str = "E5", one: str = "dinov3", other: str = "random") -> DataFrame:
    """The contrasts of initialization among run_pairs(): across and within initializations, of the same and of different objectives, by arm. Arms without a pair across initializations have none."""
    rows = rows.filter((F.col("experiment") == experiment) & (F.col("backbone_a") == backbone) & (F.col("backbone_b") == backbone))
    crossed = rows.filter("init_a <> init_b").select(F.col("arm_a").alias("_arm")).distinct()
    rows = rows.join(crossed, F.col("arm_a") == F.col("_arm"), "left_semi")
    cross, same = F.col("init_a") != F.col("init_b"), F.col("level_a") == F.col("level_b")
    both = lambda i: (F.col("init_a") == i) & (F.col("init_b") == i)
    setting = F.concat(F.col("arm_a"), F.lit(f"/{backbone}"))
    return _contrasted(rows, [
        ("same_objective_across_initializations", setting, cross & same),
        ("different_objectives_across_initializations", setting, cross & ~same),
        (f"different_objectives_both_{other}", setting, both(other)),
        (f"same_objective_seed_pairs_both_{one}", setting, both(one) & same & (F.col("seed_a") != F.col("seed_b"))),
        (f"different_objectives_both_{one}", setting, both(one) & ~same),
    ])


def initialization_difference(long: DataFrame) -> DataFrame:
    """(setting, difference, crossed_std, crossed_ci_low, crossed_ci_high, p_raw, n_pairs_a, n_pairs_b, crossed_n_cells): same less different objectives across initializations, with the normal p of the error over runs."""
    same = F.col("contrast") == "same_objective_across_initializations"
    rows = cut(long.filter(same | (F.col("contrast") == "different_objectives_across_initializations")))
    gap = F.avg(F.when(same, F.col("v"))) - F.avg(F.when(~same, F.col("v")))
    per = rows.groupBy("setting").agg(gap.alias("d"), F.count(F.when(same, 1)).alias("a"), F.count(F.when(~same, 1)).alias("b")).filter("a > 0 AND b > 0")
    found = per.join(_by_runs(rows, ["setting"], gap), "setting").collect()  # a row for each arm
    out = [(r.setting, r.d, r["std"], *((r.d - 1.96 * r["std"], r.d + 1.96 * r["std"]) if r["std"] is not None else (None, None)), I.normal_p(r.d, r["std"]), r.a, r.b, r.n_units) for r in found]
    return long.sparkSession.createDataFrame(out, "setting string, difference double, crossed_std double, crossed_ci_low double, crossed_ci_high double, p_raw double, n_pairs_a long, n_pairs_b long, crossed_n_cells long")


def disjoint_pairs(rows: DataFrame, experiment: str = "E5_disjoint", setting: str = "cxr_disjoint/vit_s") -> DataFrame:
    """The contrasts of training halves without shared patients: within a half, and across halves with the same and with different seeds."""
    half, seed = F.col("arm_a") == F.col("arm_b"), F.col("seed_a") == F.col("seed_b")
    return _contrasted(rows.filter(F.col("experiment") == experiment), [("within_half_different_seed", setting, half & ~seed), ("across_halves_different_seed", setting, ~half & ~seed), ("across_halves_same_seed", setting, ~half & seed)])


def content_pairs(rows: DataFrame, arm: str = "frame_cxr", level: str = "image_text") -> DataFrame:
    """The contrasts of content: natural training among seeds, and each altered condition of it against natural training."""
    rows = rows.filter((F.col("arm_a") == arm) & (F.col("backbone_a") == F.col("backbone_b")) & F.startswith("level_a", F.lit(level)) & F.startswith("level_b", F.lit(level)))
    a, b, seed = F.col("level_a") == level, F.col("level_b") == level, F.col("seed_a") == F.col("seed_b")
    altered, setting = F.when(a, F.col("level_b")).otherwise(F.col("level_a")), F.concat(F.lit(f"{arm}/"), F.col("backbone_a"))
    return _contrasted(rows, [
        ("natural_seed_pairs", setting, a & b & ~seed),
        (F.concat(altered, F.lit("_vs_natural_different_seed")), setting, (a != b) & ~seed),
        (F.concat(altered, F.lit("_vs_natural_same_seed")), setting, (a != b) & seed),
    ])


def retention_rows(rows: DataFrame, cells: DataFrame, init: str = "dinov3") -> DataFrame:
    """(contrast, setting, level, alignment, n_cells, min_raw, max_raw, seed_pair_agreement): how much of its initialization each kind of run (arm_group, backbone, axis_level, mknn) keeps, beside the agreement of its seeds."""
    same = rows.filter((F.col("init_a") == init) & (F.col("init_b") == init) & (F.col("backbone_a") == F.col("backbone_b")) & (F.col("level_a") == F.col("level_b")) & (F.col("seed_a") != F.col("seed_b")))
    seeds = same.groupBy(F.col("arm_a").alias("_arm"), F.col("backbone_a").alias("_backbone"), F.col("level_a").alias("_level")).agg(F.avg("v").alias("seed_pair_agreement"))
    per = cells.groupBy("arm_group", "backbone", "axis_level").agg(F.avg("mknn").alias("alignment"), F.count("*").alias("n_cells"), F.min("mknn").alias("min_raw"), F.max("mknn").alias("max_raw"))
    out = per.join(seeds, (F.col("arm_group") == F.col("_arm")) & (F.col("backbone") == F.col("_backbone")) & (F.col("axis_level") == F.col("_level")), "left")
    return out.select(F.lit("cell_to_initialization").alias("contrast"), F.concat_ws("/", "arm_group", "backbone").alias("setting"), F.col("axis_level").alias("level"), "alignment", "n_cells", "min_raw", "max_raw", "seed_pair_agreement")


def _existing(rows: DataFrame, files: DataFrame | None, *parts: str | Column) -> DataFrame:
    """Rows whose image is among the files, if files are given; parts of the path are joined by slashes."""
    if files is None:
        return rows
    at = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return with_files(rows.withColumn("_path", at), files, "_path").drop("_path")


def fundus_pool(master: DataFrame, source: str, id_col: str, grade_col: str, cap: int, split: str = "train", referable: float = 2, gradable: str | None = None, suffix: str = "", root: str = "", files: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Manifest of graded fundus images: as many referable ones (grade of `referable` or more) as others, at most cap of each.

    Rows that are not gradable drop out first; a grade that is no number is NULL and not referable.
    """
    rows = master.filter(F.col(gradable) == 1) if gradable and gradable in master.columns else master
    rows = rows.withColumn("_key", F.concat(F.col(id_col).cast("string"), F.lit(suffix))).withColumn("_grade", F.expr(f"try_cast(`{grade_col}` AS double)"))
    rows = _existing(rows.withColumn("_label", F.coalesce((F.col("_grade") >= referable).cast("double"), F.lit(0.0))), files, root, source, F.col("_key"))
    chosen = S.balanced(rows, "_label", cap, seed, id_col)
    return chosen.select(
        F.concat(F.lit(f"fundus__{source}__"), F.col(id_col).cast("string")).alias("case_id"), F.lit(f"fundus_{source}").alias("dataset"), F.lit("fundus").alias("modality"), F.lit(split).alias("split"),
        F.col("_key").alias("image_key"), F.lit(source).alias("image_subdir"), F.col("_label").alias("referable_dr"), F.col("_grade").alias("dr_grade"), F.lit(source).alias("source_tag"),
    )


def tissue_pool(files: DataFrame, dataset: str, splits: dict[str, str], classes: Sequence[str], cap: int, tumor: Sequence[str] = ("TUM",), pattern: str = r"\.tif$", seed: int = 42) -> DataFrame:
    """Manifest of a tree of folders, one for each split and in it one for each tissue class: at most cap images of a class over all splits.

    files has the path of each file; splits maps folders to splits. Other folders, classes and names that the pattern does not find are left out.
    """
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -3).alias("_folder"), F.element_at(parts, -2).alias("tissue_class"), F.element_at(parts, -1).alias("_name"))
    rows = rows.filter(F.col("_folder").isin(*splits) & F.col("tissue_class").isin(*classes) & F.col("_name").rlike(pattern))
    split = F.create_map(*(F.lit(x) for p in splits.items() for x in p))[F.col("_folder")]
    rows = rows.withColumn("split", split).withColumn("case_id", F.concat(F.lit(f"{dataset}__"), F.concat_ws("_", split, "tissue_class", F.regexp_replace("_name", r"\.[^.]*$", ""))))
    return S.cap_per_group(rows, "tissue_class", cap, seed, "case_id").select(
        "case_id", F.lit(dataset).alias("dataset"), F.lit("histo").alias("modality"), "split", F.concat_ws("/", "_folder", "tissue_class", "_name").alias("image_key"), F.lit(None).cast("string").alias("image_subdir"),
        "tissue_class", F.col("tissue_class").isin(*tumor).cast("double").alias("tumor_label"),
    )


def acquisition_pool(master: DataFrame, dataset: str, order: Sequence[str], reports: Sequence[str] = (), modalities: Sequence[str] = ("CR", "DX", "DR"), views: Sequence[str] = ("AP", "PA"), cap: int = 0, seed: int = 42) -> DataFrame:
    """Manifest of images with the institution and the maker of their device, cut to cap rows by whole subjects.

    master has ImagePath, split, subject_id, institution, manufacturer, view and perhaps ImageModality. Rows of other modalities and views drop
    out, the rest are numbered in the given order, and then those without an institution or a maker drop out. Leading ../ go, lists of makers become one name, and
    the sections of reports are joined by a space, NULL where there are no such columns.
    """
    rows = master.filter(F.col("ImageModality").isin(*modalities)) if "ImageModality" in master.columns else master
    rows = positions(rows.filter(F.col("view").isin(*views)), order, "_number")
    told = [c for c in reports if c in master.columns]
    text = F.trim(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in told))) if told else F.lit(None).cast("string")
    split = F.when(F.lower("split") == "val", "valid").otherwise(F.lower("split"))
    pool = rows.select(
        F.concat(F.lit(f"{dataset}__"), F.col("_number").cast("string")).alias("case_id"), F.lit(dataset).alias("dataset"), F.lit("cxr").alias("modality"), F.regexp_replace("ImagePath", r"^(\.\./)+", "").alias("image_key"), split.alias("split"),
        "subject_id", X.vendor(F.col("institution")).alias("institution"), X.vendor(F.col("manufacturer")).alias("manufacturer"), "view", text.alias("report_text"),
    ).filter("institution IS NOT NULL AND manufacturer IS NOT NULL")
    if not cap:
        return pool
    pool = cut(pool)
    return pool if pool.count() <= cap else S.take_fitting(pool.filter("subject_id IS NOT NULL"), "subject_id", cap, seed, "dataset")


def with_transfer_columns(ladder: DataFrame) -> DataFrame:
    """ladder with above_reference_p975 (whether the transfer's AUROC passes the end of its reference, 1 or 0) and the retention above chance, both NULL where they make no sense."""
    t, hi, o = (F.col(c).cast("double") for c in ("auroc_transfer", "reference_ci_high", "auroc_oracle"))
    return ladder.withColumn("above_reference_p975", (t > hi).cast("double")).withColumn("retention_chance_corrected", F.when(o > 0.5, (t - 0.5) / (o - 0.5)))


def transfer_summary(ladder: DataFrame) -> DataFrame:
    """Of each step of a ladder of with_transfer_columns(): pairs, shares above the reference and significant, the least p that its replicates allow, medians."""
    middle = lambda c, name: F.median(c).alias(name)
    return ladder.groupBy("step").agg(
        F.count("*").alias("n_pairs"), F.avg("above_reference_p975").alias("share_above_reference_p975"), F.avg(F.coalesce((F.col("p_fdr") < 0.05).cast("double"), F.lit(0.0))).alias("share_significant_fdr"),
        (1.0 / (F.max("n_perm") + 1)).alias("min_attainable_p"), middle("auroc_transfer", "median_transfer_auroc"), middle("auroc_oracle", "median_oracle_auroc"), middle("retention", "median_retention"), middle("retention_chance_corrected", "median_retention_chance_corrected"),
    )


_LEVELS = {"finding": ["finding"], "encoder_pair": ["enc_train", "enc_eval"], "objective_pair": ["objective_train", "objective_eval"], "anchor_budget": ["n_anchors"]}


def paired_summaries(transfer: DataFrame, budgets: Sequence[int], primary: int, spaces: Sequence[str] = ("anchor", "native"), replicates: int = 1000, seed: int = 0, least: int = 5) -> DataFrame:
    """(level, group, comparator, label_budget, mean, n, std, ci_low, ci_high, p_raw, p_fdr): transfer by finding, pair of encoders, pair of objectives and number of anchors.

    A row without a comparator is the mean retention; the others are the paired difference of the transfer's AUROC from that of a refit on a budget of labels
    (columns refit_{space}_b{budget}), for groups with `least` pairs. All levels but the last take the primary number of anchors; p is adjusted within level and comparator.
    """
    none = F.lit(None)
    rows = []
    for level, cols in _LEVELS.items():
        own = transfer if level == "anchor_budget" else transfer.filter(F.col("n_anchors") == primary)
        base = [F.lit(level).alias("level"), F.concat_ws("|", *(F.col(c).cast("string") for c in cols)).alias("group")]
        rows.append(own.select(*base, none.cast("string").alias("comparator"), none.cast("int").alias("label_budget"), F.col("retention").cast("double").alias("v")))
        for space in spaces:
            for b in budgets:
                if (name := f"refit_{space}_b{b}") in transfer.columns:
                    rows.append(own.select(*base, F.lit(f"refit_{space}").alias("comparator"), F.lit(b).alias("label_budget"), (F.col("auroc_xenc") - F.col(name)).alias("v")))
    every = rows[0]
    for one in rows[1:]:
        every = every.unionByName(one)
    by = ["level", "group", "comparator", "label_budget"]
    found = I.grouped_means(every, "v", by, replicates, seed, tested=True)
    p = F.when(F.col("comparator").isNotNull(), F.col("p_value")).alias("p_raw")
    found = found.filter(F.col("comparator").isNull() | (F.col("n") >= least)).select(*by, F.col("point").alias("mean"), "n", "std", "ci_low", "ci_high", p)
    return I.benjamini_hochberg(found, "p_raw", ["level", "comparator"]).drop("significant_fdr05")


def acquisition_predictability(vectors: DataFrame, cases: DataFrame, targets: Sequence[str], subject: str, anchors: DataFrame | None = None, seed: int = 42, least: int = 500, replicates: int = 1000) -> DataFrame:
    """(encoder, target, space, accuracy, ci_low, ci_high, majority_baseline, accuracy_above_baseline, n_classes, n_train, n_test): how well the maker of a device, say, is told from vectors.

    cases holds (case_id, subject, targets). A probe learns on the cases of 70 % of the subjects and is tested on the rest, in the encoder's own space and, with at least 64
    anchors (case_id, pos), in that of its anchors; classes need 20 training cases. Encoders with fewer than `least` cases and probes with fewer than 200 cases in all, 100 to learn from or 50 to be tested on have no row.
    The interval is a bootstrap over subjects.
    """
    parts = S.unit_split(cases.select("case_id", subject, *targets), subject, seed)
    spaces = {"native": V.finite_rows(vectors.select("encoder", "case_id", "embedding"))}
    if anchors is not None and anchors.count() >= 64:
        spaces["shared_anchor"] = V.finite_rows(V.relative(vectors, anchors).withColumnRenamed("relative", "embedding"))
    out = []
    for space, table_ in spaces.items():
        rows = cut(table_.join(parts, "case_id"))
        for e in [r.encoder for r in rows.groupBy("encoder").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("encoder").collect()]:
            for target in targets:
                own = rows.filter((F.col("encoder") == e) & F.col(target).isNotNull())
                train, test = own.filter("part = 'train'"), own.filter("part = 'test'")
                kept = [r[0] for r in train.groupBy(target).agg(F.count("*").alias("n")).filter("n >= 20").orderBy(target).collect()]
                a, b = (df.filter(F.col(target).isin(*kept)) if kept else df.limit(0) for df in (train, test))
                n, m = a.count(), b.count()
                if len(kept) < 2 or n + m < 200 or n < 100 or m < 50:
                    continue
                number = F.create_map(*(F.lit(x) for i, k in enumerate(kept) for x in (k, i)))[F.col(target)]
                scored = cut(P.fit_probe(a.withColumn("_y", number), "_y").score(b.withColumn("_y", number)).select(subject, "_y", (F.col("predicted") == F.col("_y")).cast("double").alias("_right")))
                r = I.cluster_bootstrap_mean(scored, "_right", subject, replicates, seed).first()
                base = scored.groupBy("_y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] / m
                out.append((e, target, space, r.point, r.ci_low, r.ci_high, base, r.point - base, len(kept), n, m))
    return vectors.sparkSession.createDataFrame(out, "encoder string, target string, space string, accuracy double, ci_low double, ci_high double, majority_baseline double, accuracy_above_baseline double, n_classes int, n_train long, n_test long")


@dataclass(frozen=True)
class Consensus:
    """What consensus() makes: audit of the encoders, their residuals, the consensus vectors and the deviation of each case, and the state."""

    audit: DataFrame
    residuals: DataFrame
    vectors: DataFrame
    deviations: DataFrame
    state: str


def consensus_audit(vectors: DataFrame, requested: Sequence[str], least_finite: float = 0.5) -> DataFrame:
    """(encoder, finite_row_fraction, status): USED, SKIPPED_MOSTLY_NAN below least_finite, or MISSING."""
    finite = V.finite_rows(vectors).groupBy(F.col("encoder").alias("_e")).agg(F.count("*").alias("_f"))
    share = vectors.groupBy("encoder").agg(F.count("*").alias("_n")).join(finite, F.col("encoder") == F.col("_e"), "left").select("encoder", (F.coalesce("_f", F.lit(0)) / F.col("_n")).alias("share"))
    wanted = vectors.sparkSession.createDataFrame([(e,) for e in requested], "encoder string")
    status = F.when(F.col("share").isNull(), "MISSING").when(F.col("share") < least_finite, "SKIPPED_MOSTLY_NAN").otherwise("USED")
    return wanted.join(share, "encoder", "left").select("encoder", F.coalesce("share", F.lit(0.0)).alias("finite_row_fraction"), status.alias("status"))


def consensus(vectors: DataFrame, anchors: DataFrame, requested: Sequence[str], iterations: int = 2000, tolerance: float = 1e-6, k: int = 10, lost_encoders: float = 0.25, lost_cases: float = 0.2, deviation_cases: int = 20_000, seed: int = 42) -> Consensus:
    """The consensus of encoders over the cases that all of them have: audit, relative vectors, rotations, deviations.

    Encoders that are absent or mostly not finite are left out; the build fails if that is more than lost_encoders of those requested, if fewer than two are left, or if more
    than lost_cases of the cases lack a finite vector of one of the rest. Vectors are those relative to the anchors (case_id, pos). The deviation of
    a case is 1 less the Jaccard of all encoders' k neighbours, among at most deviation_cases cases by hash; others have none.
    """
    audit = cut(consensus_audit(vectors, requested))
    used = sorted(r.encoder for r in audit.filter("status = 'USED'").collect())
    if len(used) < 2 or len(requested) - len(used) > lost_encoders * len(requested):
        raise ValueError(f"{len(used)} of {len(requested)} encoders are usable")
    own = vectors.filter(F.col("encoder").isin(*used))
    rel = cut(V.finite_rows(V.relative(own, anchors).withColumnRenamed("relative", "embedding")))
    shared = cut(R.in_all(rel, "case_id", "encoder"))
    total = own.select("case_id").distinct().count()
    if shared.count() < max(2, (1 - lost_cases) * total):
        raise ValueError("too few cases have a finite vector of every encoder")
    rel = cut(rel.join(shared, "case_id", "left_semi"))
    residual, history, converged, maps = A.consensus_maps(V.grams(rel), used, iterations, tolerance)
    change = abs(history[-1] - history[-2]) if len(history) > 1 else None
    spark = vectors.sparkSession
    residuals = spark.createDataFrame([(e, residual[e], converged, len(history), history[-1], change, tolerance) for e in used], "encoder string, residual double, converged boolean, iterations int, final_mean_distance double, last_change double, tolerance double")
    moved = None
    for e in used:
        one = P.mapped(rel.filter(F.col("encoder") == e).select("case_id", F.col("embedding").cast("array<double>").alias("embedding")), maps[e])
        moved = one if moved is None else moved.unionByName(one)
    add = lambda s, x: F.zip_with(s, x, lambda a, b: a + b)
    listed = moved.groupBy("case_id").agg(F.collect_list("embedding").alias("_v"))  # one of each encoder
    agreed = cut(listed.select("case_id", F.aggregate(F.slice("_v", 2, max(1, len(used) - 1)), F.col("_v")[0], add).alias("embedding")))
    chosen = S.capped(shared, deviation_cases, seed, "case_id")
    near = V.neighbour_lists(V.knn_edges(rel.join(chosen, "case_id", "left_semi"), k))
    deviations = shared.join(A.case_agreement(near, k).select("case_id", "deviation"), "case_id", "left")
    return Consensus(audit, residuals, agreed, deviations, A.consensus_state(len(used), len(used), converged))
