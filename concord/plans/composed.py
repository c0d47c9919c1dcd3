"""Queries of the compositions, on fixtures in the role of their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.operators import inference as I
from concord.operators.resampling import drawn_sql
from concord.plans import pipelines as C
from concord.plans.catalogue import query, table
from concord.plans.geometry import _CENTRES, _RANKED, K, _edges, _mknn, _view, views
from concord.plans.manifest import _PAIRS, nation_pairs
from concord.plans.statistics import _rank, _shuffled, rounded


@query("""SELECT doc_id::VARCHAR AS case_id, 'quality' AS finding, 'canonical' AS vocabulary, CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.0::DOUBLE END AS value FROM labels
UNION ALL SELECT doc_id::VARCHAR, 'harm', 'canonical', CASE WHEN toxic = 1 THEN 1.0::DOUBLE WHEN toxic = 0 THEN 0.0::DOUBLE END FROM labels""")
def policy_decode(spark, d):
    long = table(spark, d, "labels").unpivot([F.col("doc_id").cast("string").alias("case_id")], [F.col(c).cast("string").alias(c) for c in ("quality", "toxic")], "native", "code").withColumn("site", F.lit("s"))
    policies = spark.createDataFrame([("s", "quality", "quality", "canonical", 1.0, [0.0]), ("s", "toxic", "harm", "canonical", 1.0, [0.0])], "site string, native string, finding string, vocabulary string, positive double, negatives array<double>")
    return L.decode_by_policy(long, policies)


@query(r"""WITH m AS (SELECT source AS dataset, doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE source <> 'src0' OR lang IN ('en', 'fr'))
SELECT dataset || '__d' || doc_id AS case_id, dataset, 'cxr' AS modality, CASE WHEN doc_id % 3 = 0 THEN 'valid' ELSE 'train' END AS split, quality::DOUBLE AS good FROM m""")
def pool_build(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    docs = docs.select(F.concat(F.lit("d"), "doc_id").alias("image_key"), F.col("lang").alias("view"), F.when(F.col("doc_id") % 3 == 0, "VAL").otherwise("Train").alias("split"), F.lit(None).cast("string").alias("image_subdir"), "quality", "source")
    sites = sorted(r[0] for r in docs.select("source").distinct().collect())
    policies = spark.createDataFrame([(s, "quality", "good", "canonical", 1.0, [0.0]) for s in sites], "site string, native string, finding string, vocabulary string, positive double, negatives array<double>")
    masters = {s: docs.filter(F.col("source") == s).drop("source") for s in sites}
    return C.build_pool(masters, policies, {s: ["en", "fr"] if s == "src0" else None for s in sites}, ["good"]).select("case_id", "dataset", "modality", "split", "good")


@query("""SELECT o_orderkey AS case_id, o_orderpriority AS dataset, CASE o_orderstatus WHEN 'P' THEN 'train' ELSE 'test' END AS split, o_custkey AS subject_id,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'external' WHEN o_orderstatus = 'P' THEN 'development' ELSE 'internal_test' END AS role FROM orders""")
def split_roles(spark, d):
    pool = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("dataset"), F.when(F.col("o_orderstatus") == "P", "train").otherwise("test").alias("split"), F.col("o_custkey").alias("subject_id"))
    return C.case_splits(pool, ["1-URGENT"])


def _pair_overlaps(*names: str) -> str:
    return f"""{_edges(*names)}, q AS (SELECT * FROM (VALUES (5), (10)) t(k)),
o AS (SELECT k, x.e AS ea, p.e AS eb, x.src, count(y.dst)::DOUBLE / k AS overlap FROM q JOIN edge x ON x.r <= k JOIN (SELECT DISTINCT e FROM edge) p ON x.e < p.e LEFT JOIN edge y ON y.e = p.e AND y.src = x.src AND y.dst = x.dst AND y.r <= k GROUP BY k, x.e, p.e, x.src)"""


@query(f"""WITH {_pair_overlaps('full', 'va', 'vb', 'floor_a')}, n AS (SELECT greatest(1, round_even(0.632 * count(DISTINCT src), 0)) AS m FROM edge),
s AS (SELECT b, src, k AS place FROM {_shuffled('SELECT DISTINCT src FROM edge', 'src', 'src', 200)}), w AS (SELECT k, ea, eb, b, avg(overlap) AS draw FROM o JOIN s USING (src), n WHERE place < m GROUP BY ALL),
i AS (SELECT k, ea, eb, stddev_samp(draw) AS sd, quantile_cont(draw, 0.025) AS lo, quantile_cont(draw, 0.975) AS hi FROM w GROUP BY ALL)
SELECT ea AS encoder_a, eb AS encoder_b, 'mknn_k' || k AS metric, round(avg(overlap), 6) AS value, count(*) AS n, CASE WHEN 'floor_a' IN (ea, eb) THEN 'floor' ELSE 'within' END AS comparison_type,
round(any_value(sd), 6) AS value_std, round(any_value(lo), 6) AS value_ci_low, round(any_value(hi), 6) AS value_ci_high FROM o JOIN i USING (k, ea, eb) GROUP BY k, ea, eb""")
def pairwise_map(spark, d):
    return rounded(C.pairwise_map(views(spark, d, "full", "va", "vb", "floor_a"), [5, K], replicates=200, floor=["floor_a"]), "value", "value_std", "value_ci_low", "value_ci_high")


_FIVE = "SELECT ea, eb, avg(overlap) AS v, ea NOT LIKE 'floor%' AND eb NOT LIKE 'floor%' AS f FROM o WHERE k = 10 GROUP BY ALL"


@query(f"""WITH {_pair_overlaps('full', 'va', 'vb', 'floor_a', 'floor_b')}, p AS ({_FIVE}), c AS (SELECT avg(v) FILTER (f) - avg(v) FILTER (NOT f) AS difference, count(*) FILTER (f) AS n_a, count(*) FILTER (NOT f) AS n_b FROM p),
r AS (SELECT b, avg(v) FILTER (k < n_a) - avg(v) FILTER (k >= n_a) AS draw FROM {_shuffled('FROM p', 'ea, eb', 'v', 999)}, c GROUP BY b), t AS (SELECT (count(*) FILTER (abs(draw) >= abs(difference) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE AS p FROM r, c)
SELECT 'mknn_k10' AS metric, round(difference, 6) AS difference, n_a, n_b, p AS p_raw, p AS p_fdr, p < 0.05 AS significant_fdr05 FROM c, t""")
def pairwise_map_summary(spark, d):
    return rounded(C.map_summary(C.pairwise_map(views(spark, d, "full", "va", "vb", "floor_a", "floor_b"), [K], floor=["floor_a", "floor_b"]), 999), "difference")


@query(_mknn("va", "vb").replace("AS mknn", "AS value"))
def cross_modal_map(spark, d):
    return rounded(C.cross_map(views(spark, d, "va", "vb"), ["va"], ["vb"], K), "value")


@query(f"""WITH {_CENTRES.format('embeddings')}, p AS (SELECT a.label AS a, b.label AS b, 1 - list_inner_product(a.v, b.v) / (a.s * b.s) AS x, (b.label - a.label)::DOUBLE AS y FROM c a JOIN c b ON a.label < b.label),
u AS (SELECT label AS o, row_number() OVER (ORDER BY label) - 1 AS i FROM c), t AS (SELECT b AS rep, o AS dest, k FROM {_shuffled('FROM u', 'o', 'o', 999)}),
g AS (SELECT rep, u.o AS src, dest FROM t JOIN u ON t.k = u.i), w AS (SELECT ga.rep, p.x, q.y FROM p JOIN g ga ON ga.src = p.a JOIN g gb ON gb.src = p.b AND gb.rep = ga.rep JOIN p q ON q.a = least(ga.dest, gb.dest) AND q.b = greatest(ga.dest, gb.dest)),
r AS (SELECT rep, {_rank('x', 'rep')} AS x, {_rank('y', 'rep')} AS y FROM w), d AS (SELECT rep, corr(x, y) AS draw FROM r GROUP BY 1), o0 AS (SELECT {_rank('x')} AS x, {_rank('y')} AS y FROM p), o AS (SELECT corr(x, y) AS s, count(*) AS n FROM o0)
SELECT round(s, 6) AS spearman, n, (SELECT (count(*) FILTER (abs(draw) >= abs(s) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM d) AS p_value FROM o""")
def ontology_link(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding")
    pairs = spark.range(10).select(F.col("id").alias("a")).crossJoin(spark.range(10).select(F.col("id").alias("b"))).filter("a < b")  # ten classes
    return rounded(C.ontology_link(e, "label", pairs.select(F.col("a").cast("int").alias("finding_a"), F.col("b").cast("int").alias("finding_b"), (F.col("b") - F.col("a")).cast("double").alias("d")), 999), "spearman")


@query("""WITH e AS (SELECT c_nationkey, count(*)::DOUBLE AS params, avg(c_acctbal) AS auroc, max(c_acctbal) AS agreement FROM customer GROUP BY 1), l AS (
SELECT 'agreement' AS outcome, 'params' AS axis, log10(params) AS x, agreement AS y FROM e UNION ALL SELECT 'agreement', 'auroc', auroc, agreement FROM e),
r AS (SELECT *, (rank() OVER (PARTITION BY axis ORDER BY x) + (count(*) OVER (PARTITION BY axis, x) - 1) / 2.0)::DOUBLE AS rx, (rank() OVER (PARTITION BY axis ORDER BY y) + (count(*) OVER (PARTITION BY axis, y) - 1) / 2.0)::DOUBLE AS ry FROM l)
SELECT outcome, axis, round(regr_slope(y, x), 4) AS slope, round(regr_r2(y, x), 6) AS r_squared, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY ALL""")
def scaling_fits(spark, d):
    e = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("params"), F.avg("c_acctbal").alias("auroc"), F.max("c_acctbal").alias("agreement"))
    out = C.scaling_fits(e, ["agreement"], ["params", "auroc"], ["params"])
    return rounded(rounded(out.select("outcome", "axis", "slope", "r_squared", "n", "spearman"), "slope", digits=4), "r_squared", "spearman")


def _knn_among(cases: str, group: str, names: tuple[str, ...], k: int) -> str:
    """DuckDB: edges (g, e, src, dst) of each view among the cases (id, group) of each draw, and their pairwise overlaps o (g, ea, eb, src, overlap)."""
    return f"""x AS ({' UNION ALL '.join(_view(n) for n in names)}), g AS ({cases}), xg AS (SELECT x.e, x.id, x.v, g.{group} AS g FROM x JOIN g ON x.id = g.id),
edge AS (SELECT * FROM (SELECT a.g, a.e, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.g, a.e, a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r FROM xg a JOIN xg b ON a.g = b.g AND a.e = b.e AND a.id <> b.id) WHERE r <= {k}),
o AS (SELECT x.g, x.e AS ea, p.e AS eb, x.src, count(y.dst)::DOUBLE / {k} AS overlap FROM edge x JOIN (SELECT DISTINCT e FROM edge) p ON x.e < p.e LEFT JOIN edge y ON y.g = x.g AND y.e = p.e AND y.src = x.src AND y.dst = x.dst GROUP BY ALL)"""


_POSITIVES = "SELECT id, finding FROM (SELECT vec_id AS id, 'f' || label AS finding, row_number() OVER (PARTITION BY label ORDER BY md5('0|f' || label || '|' || vec_id), 'f' || label || '|' || vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE r <= 30 AND n >= 30"


@query(f"""WITH {_knn_among(_POSITIVES, 'finding', ('va', 'vb'), 5)} SELECT g AS finding, ea AS encoder_a, eb AS encoder_b, round(avg(overlap), 6) AS mknn, count(*) AS n FROM o GROUP BY ALL""")
def finding_agreement(spark, d):
    e = table(spark, d, "embeddings")
    positives = e.select(F.col("vec_id").alias("case_id"), F.concat(F.lit("f"), "label").alias("finding"))
    return rounded(C.finding_agreement(views(spark, d, "va", "vb").drop("label"), positives, 30, 5), "mknn")


def _ladder(name: str) -> str:
    return f"""SELECT '{name}' AS encoder, round(corr(x, y), 5) AS spearman, count(*) AS n FROM (SELECT {_RANKED.format('g')} AS x, {_RANKED.format('dist')} AS y FROM (
SELECT least(e.label, 4) AS g, 1 - list_inner_product(x.v, c.v) AS dist FROM ({_view(name)}) x JOIN embeddings e ON e.vec_id = x.id, (SELECT list(m / s ORDER BY i) AS v FROM (SELECT i, m, greatest(sqrt(sum(m * m) OVER ()), 1e-9) AS s FROM (
SELECT i, avg(x.v[i]) AS m FROM ({_view(name)}) x JOIN embeddings e ON e.vec_id = x.id, unnest(range(1, len(x.v) + 1)) t(i) WHERE e.label = 0 GROUP BY 1))) c WHERE e.label >= 1))"""


@query(f"{_ladder('full')} UNION ALL {_ladder('va')}")
def grade_ladder(spark, d):
    grades = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.least("label", F.lit(4)).alias("grade"))
    return rounded(C.grade_ladder(views(spark, d, "full", "va").drop("label"), grades, 20, 100), "spearman", digits=5)


_DRAWS = """SELECT id, 'within:' || maker AS finding FROM (SELECT vec_id AS id, label % 2 AS maker, row_number() OVER (PARTITION BY label % 2 ORDER BY md5('0|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label % 2) AS n FROM embeddings) WHERE r <= 100 AND n >= 100
UNION ALL SELECT id, 'random:' || i FROM (SELECT vec_id AS id, i, row_number() OVER (PARTITION BY i ORDER BY md5('0:' || i || '|' || vec_id), vec_id) AS r FROM embeddings, (VALUES (0), (1)) t(i)) WHERE r <= 100"""


@query(f"""WITH {_knn_among(_DRAWS, 'finding', ('va', 'vb'), 5)} SELECT g AS draw, split_part(g, ':', 1) AS arm, ea AS encoder_a, eb AS encoder_b, round(avg(overlap), 6) AS mknn FROM o GROUP BY ALL""")
def acquisition_draws(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), (F.col("label") % 2).alias("maker"))
    return rounded(C.within_group_draws(views(spark, d, "va", "vb").drop("label"), e, "maker", 100, 5), "mknn")


@query(f"""WITH {_knn_among(_DRAWS, 'finding', ('va', 'vb'), 5)}, m AS (SELECT g AS draw, split_part(g, ':', 1) AS arm, avg(overlap) AS v FROM o GROUP BY ALL), c AS (SELECT avg(v) FILTER (arm = 'within') AS w, avg(v) FILTER (arm <> 'within') AS a, count(*) FILTER (arm = 'within') AS n FROM m),
r AS (SELECT b, avg(v) FILTER (k < n) - avg(v) FILTER (k >= n) AS draw FROM {_shuffled('FROM m', 'draw', 'v', 999)}, c GROUP BY b)
SELECT 'va' AS encoder_a, 'vb' AS encoder_b, 'acquisition' AS test, n::INT AS n_manufacturers, '0;1' AS manufacturers, 100 AS matched_n, 5 AS k, round(w - a, 6) AS difference, round(w, 6) AS within_mean, round(a, 6) AS across_mean,
(SELECT (count(*) FILTER (abs(draw) >= abs(w - a) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) AS p_raw FROM c""")
def acquisition_arm(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), (F.col("label") % 2).alias("maker"))
    return rounded(C.acquisition_arm(views(spark, d, "va", "vb").drop("label"), e, "maker", 100, 5, 999), "difference", "within_mean", "across_mean")


_SAME = "SELECT id, 'draw ' || i AS finding FROM (SELECT vec_id AS id, i, row_number() OVER (PARTITION BY i ORDER BY md5('0:' || i || '|' || vec_id), vec_id) AS r FROM embeddings, (SELECT unnest(range(0, greatest(4, (SELECT count(*) FROM embeddings) // 60))) AS i)) WHERE r <= 60"


@query(f"""WITH {_knn_among(_SAME, 'finding', ('va', 'vb', 'floor_a', 'floor_b'), 5)}, m AS (SELECT g, avg(overlap) FILTER (ea = 'va' AND eb = 'vb') AS native, avg(overlap) FILTER (ea = 'floor_a' AND eb = 'floor_b') AS harmonized FROM o GROUP BY 1),
j AS (SELECT harmonized - native AS d, row_number() OVER (ORDER BY harmonized - native) - 1 AS i FROM m), r AS (SELECT x.b, avg(j.d) AS draw FROM {drawn_sql('SELECT harmonized - native AS d FROM m', 'd', 1000, 0)} x JOIN j ON x.k = j.i GROUP BY 1)
SELECT 'one' AS encoder_a, 'two' AS encoder_b, 'preprocessing' AS test, (SELECT count(*) FROM m) AS n_draws, (SELECT round(avg(native), 6) FROM m) AS native_mean, (SELECT round(avg(harmonized), 6) FROM m) AS harmonized_mean, (SELECT round(avg(d), 6) FROM j) AS difference,
round(quantile_cont(draw, 0.025), 6) AS ci_low, round(quantile_cont(draw, 0.975), 6) AS ci_high, round(greatest(avg((abs(draw - (SELECT avg(d) FROM j)) >= abs((SELECT avg(d) FROM j)) * (1 - 1e-9))::INT), 0.001), 6)::DOUBLE AS p_value, 60 AS matched_n, 5 AS k FROM r""")
def preprocessing_arm(spark, d):
    """Two encoders each in two ways: overlapping slices as native vectors, disjoint ones as harmonised."""
    of = lambda one, two: views(spark, d, one, two).drop("label").withColumn("encoder", F.when(F.col("encoder") == one, "one").otherwise("two"))
    found = C.preprocessing_arm(of("va", "vb"), of("floor_a", "floor_b"), 60, 5)
    return rounded(found, "native_mean", "harmonized_mean", "difference", "ci_low", "ci_high", "p_value")


_SITES = "SELECT id, tag AS finding FROM (SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY md5('0|' || tag || '|' || id), tag || '|' || id) AS r, count(*) OVER (PARTITION BY tag) AS n FROM (SELECT vec_id AS id, 'seen_pool' AS tag FROM embeddings UNION ALL SELECT vec_id, 'seen_pool:s' || (label % 4) FROM embeddings)) WHERE r <= 80 AND n >= 80"


@query(f"""WITH {_knn_among(_SITES, 'finding', ('full', 'va', 'vb'), 5)} SELECT ea AS encoder_a, eb AS encoder_b, g AS pool, 'pretraining_exposure' AS test, round(avg(overlap), 6) AS alignment, true AS panel_saw_this_site, 80 AS matched_n, 5 AS k FROM o GROUP BY ALL""")
def exposure_arm(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.concat(F.lit("s"), F.col("label") % 4).alias("site"))
    return rounded(C.exposure_arm(views(spark, d, "full", "va", "vb").drop("label"), e, "seen_pool", 80, 5, ["other"]), "alignment")


@query(f"""WITH p AS (SELECT a, b, v, CASE WHEN length(a) > length(b) THEN 'x' ELSE 'base' END AS g FROM {_PAIRS}), u AS (SELECT a AS unit FROM p UNION SELECT b FROM p),
l AS (SELECT unit, avg(v) FILTER (g = 'x') - avg(v) FILTER (g = 'base') AS v FROM p JOIN u ON a <> unit AND b <> unit GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT sqrt((count(v) - 1) / count(v) * var_pop(v) * count(v)) AS std FROM l WHERE v IS NOT NULL)
SELECT 'x' AS "group", 'base' AS baseline, round(avg(v) FILTER (g = 'x') - avg(v) FILTER (g = 'base'), 4) AS point, count(*) AS n, (SELECT round(std, 4) FROM e) AS std FROM p""")
def matrix_contrasts(spark, d):
    pairs = nation_pairs(spark, d).select(F.col("a").alias("run_id_a"), F.col("b").alias("run_id_b"), "v", F.when(F.length("a") > F.length("b"), "x").otherwise("base").alias("g"))
    return rounded(C.arm_contrasts(pairs, "v", "g", "base").select("group", "baseline", "point", "n", "std"), "point", "std", digits=4)


@query("""WITH s AS (SELECT o_orderpriority AS dataset, o_custkey, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY md5('0|' || o_custkey), o_custkey ROWS UNBOUNDED PRECEDING) - n AS before FROM s)
SELECT o_orderkey, dataset FROM orders o JOIN c ON o.o_custkey = c.o_custkey AND o.o_orderpriority = c.dataset WHERE before < CASE dataset WHEN '1-URGENT' THEN 200 ELSE 100 END""")
def training_mixture(spark, d):
    pool = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("subject_id"))
    return C.training_mixture(pool, {"1-URGENT": 200, "5-LOW": 100}).select("o_orderkey", "dataset")


@query("""WITH r AS (SELECT l.doc_id, quality, (n_chars > 800)::INT AS x, (n_chars > 1200)::INT AS y FROM labels l JOIN documents USING (doc_id)), k AS (SELECT avg((x = y)::INT) AS po, avg(x) AS a, avg(y) AS b, count(*) AS n FROM r)
SELECT round(avg((x = quality)::INT), 6) AS accuracy_a, round(avg((x = quality)::INT) FILTER (quality = 1), 6) AS sensitivity_a, round(avg((y = quality)::INT) FILTER (quality = 0), 6) AS specificity_b, (SELECT round((po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)), 6) FROM k) AS kappa, count(*) AS n FROM r""")
def reader_study(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    said = lambda n: rows.select(F.col("doc_id").alias("display_id"), F.when(F.col("n_chars") > n, "Yes").otherwise("no").alias("finding_present"))
    truth = rows.select(F.col("doc_id").alias("display_id"), F.col("doc_id").alias("case_id"), F.col("quality").alias("label"))
    return rounded(C.reader_study(said(800), said(1200), truth).select("accuracy_a", "sensitivity_a", "specificity_b", "kappa", "n"), "accuracy_a", "sensitivity_a", "specificity_b", "kappa")


def _dosed(d: float) -> str:
    """DuckDB: the vectors of a dose, noise from hashes beside the case's own."""
    noise = f"((('0x' || substr(md5('0:{d}|' || id || '|' || i), 1, 15))::BIGINT % 1073741824) / 1073741824.0 - 0.5) * 3.4641"
    return f"SELECT 'dose_{d}' AS e, id, list_transform(y, lambda z: z / sqrt(list_inner_product(y, y))) AS v FROM (SELECT id, list_transform(range(1, 65), lambda i: {d} * (v[i] * sqrt(64.0)) + (1 - {d}) * ({noise})) AS y FROM ({_view('full')}))"


@query(f"""WITH x AS (SELECT 'clean' AS e, id, v FROM ({_view('full')}) UNION ALL {' UNION ALL '.join(_dosed(x) for x in (0.0, 0.5, 0.9))}),
edge AS (SELECT * FROM (SELECT a.e, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.e, a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r FROM x a JOIN x b ON a.e = b.e AND a.id <> b.id) WHERE r <= {K}),
o AS (SELECT q.e, x.src, count(y.dst) / {float(K)} AS overlap FROM edge x JOIN (SELECT DISTINCT e FROM edge WHERE e <> 'clean') q ON x.e = 'clean' LEFT JOIN edge y ON y.e = q.e AND y.src = x.src AND y.dst = x.dst GROUP BY ALL)
SELECT 'clean' AS encoder_a, e AS encoder_b, round(avg(overlap), 6) AS value, count(*) AS n FROM o GROUP BY e""")
def dose_control(spark, d):
    """Agreement of a clean view with views of rising dose."""
    clean = views(spark, d, "full").drop("label")
    return rounded(C.cross_map(C.dosed_views(clean, [0.0, 0.5, 0.9]), ["clean"], ["dose_0.0", "dose_0.5", "dose_0.9"], K), "value")


@query("""SELECT event_type, count(*) AS n, round(avg(value) * 1.0, 1) AS v_mean, round(avg(value), 6) AS v_mean_raw FROM events GROUP BY 1""")
def report_columns(spark, d):
    return rounded(I.reported(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("point")), "v", share=False), "v_mean_raw")
