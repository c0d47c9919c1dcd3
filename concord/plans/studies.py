"""Queries of the suites, references, links, pools and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.functions.sites import site_policies
from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import probes as P
from concord.operators import relational as R
from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.operators.resampling import mixed_sql
from concord.plans import pipelines as C
from concord.plans.catalogue import query, table
from concord.plans.composed import _knn_among
from concord.plans.geometry import _LINEAR, _RBF, _binary, _mknn, _overlap, _rsa_sql, _weighted, views
from concord.plans.statistics import _JUDGED, _rank, _shuffled, judged, rounded
from concord.plans.transfer import labelled


_SUITE = [(f"{name}_k{k}", f"SELECT {c} FROM ({sql(k)})") for k in (5, 10) for name, c, sql in (("mknn", "mknn", lambda k: _mknn("va", "vb", k)), ("cknna", "cknna", _weighted), ("cknna_binary_graph", "cknna_binary", _binary))]
_SUITE += [("cka_linear", f"SELECT cka FROM ({_LINEAR})"), ("cka_rbf", f"SELECT cka_rbf FROM ({_RBF})"), ("rsa_spearman", f"SELECT spearman FROM ({_rsa_sql('va', 'vb')})"), ("headline_mknn", f"SELECT mknn FROM ({_mknn('va', 'vb')})"), ("headline_cknna", f"SELECT cknna FROM ({_weighted(10)})")]


@query(" UNION ALL ".join(f"SELECT '{name}' AS metric, round(({sql}), 4)::DOUBLE AS value" for name, sql in _SUITE))
def metric_suite(spark, d):
    """All metrics of two overlapping views but the Procrustes distance, which has a query of its own, as SQL has no singular values."""
    found = A.metric_suite(views(spark, d, "va", "vb"), "va", "vb", (5, 10))
    return spark.createDataFrame([(k, None if v is None else round(float(v), 4)) for k, v in found.items() if k != "procrustes"], "metric string, value double")


@query(f"WITH {_overlap('va', 'vb')} SELECT CASE WHEN count(*) >= 20 THEN round(avg(overlap), 6)::DOUBLE END AS mknn, count(*) AS n FROM o")
def safe_mknn(spark, d):
    return rounded(A.safe_mutual_knn(views(spark, d, "va", "vb"), "va", "vb"), "mknn")


@query("""SELECT c_custkey AS case_id, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 9) AS first FROM customer LEFT JOIN embeddings ON vec_id = c_custkey""")
def aligned_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding")
    out = V.aligned(table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")), v)
    return out.select("case_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"), F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 9).alias("first"))


@query("""WITH u AS (SELECT c_nationkey AS run_id, 'imported' AS source, avg(c_acctbal) AS v FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'measured', avg(s_acctbal) FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1)
SELECT run_id, source, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY source DESC) AS r FROM u) WHERE r = 1""")
def source_precedence(spark, d):
    """Measured values before imported ones, one of each run."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("run_id")).agg(F.avg("c_acctbal").alias("v")).withColumn("source", F.lit("imported"))
    s = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("run_id")).agg(F.avg("s_acctbal").alias("v")).withColumn("source", F.lit("measured"))
    return rounded(R.preferred(c.unionByName(s), ["run_id"], "source", ["measured", "imported"]).select("run_id", "source", "v"), "v")


_SITES = """SELECT doc_id::VARCHAR AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'mimic' ELSE 'vindr_cxr' END AS site, doc_id % 4 AS a, quality AS b FROM labels"""


@query(f"""WITH s AS ({_SITES}), v AS (
SELECT case_id, 'edema' AS finding, CASE WHEN a = 1 THEN 1.0 WHEN a IN (0, 2) THEN 0.0 END AS value FROM s WHERE site = 'mimic'
UNION ALL SELECT case_id, 'fracture', CASE WHEN a = 1 THEN 1.0 WHEN a = 0 THEN 0.0 END FROM s WHERE site = 'vindr_cxr'
UNION ALL SELECT case_id, 'fracture', CASE WHEN b = 1 THEN 1.0 WHEN b = 0 THEN 0.0 END FROM s WHERE site = 'vindr_cxr')
SELECT case_id, finding, 'canonical' AS vocabulary, max(value)::DOUBLE AS value FROM v GROUP BY ALL
UNION ALL SELECT case_id, 'ild', 'extended', CASE WHEN a = 1 THEN 1.0 WHEN a = 0 THEN 0.0 END::DOUBLE FROM s WHERE site = 'vindr_cxr'""")
def site_decode(spark, d):
    """Native codes of two sites under their own label maps; columns that no map has drop out."""
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "mimic").otherwise("vindr_cxr").alias("site"), (F.col("doc_id") % 4).cast("string").alias("a"), F.col("quality").cast("string").alias("b"))
    long = None
    for native, code in (("edema", "a"), ("Rib fracture", "a"), ("Clavicle fracture", "b"), ("ILD", "a"), ("no such column", "b")):
        one = rows.select("case_id", "site", F.lit(native).alias("native"), F.col(code).alias("code"))
        long = one if long is None else long.unionByName(one)
    return L.decode_by_policy(long, site_policies(spark))


_KAPPA = "CASE WHEN a * b + (1 - a) * (1 - b) <> 1 THEN (po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)) END"


@query(f"""WITH j AS (SELECT quality, (n_chars > 1000)::INT AS second, row_number() OVER (ORDER BY quality, doc_id) - 1 AS i FROM ({_JUDGED})),
m AS {_shuffled(f"SELECT doc_id, quality, (n_chars > 1000)::INT AS second FROM ({_JUDGED})", 'quality, doc_id', 'second', 1000)},
r AS (SELECT m.b AS rep, avg((quality = m.second)::INT) AS po, avg(quality) AS a, avg(m.second) AS b FROM m JOIN j ON m.k = j.i GROUP BY 1), n AS (SELECT {_KAPPA} AS draw FROM r),
o0 AS (SELECT avg((quality = second)::INT) AS po, avg(quality) AS a, avg(second) AS b, count(*) AS n FROM j), o AS (SELECT {_KAPPA} AS kappa, po, n FROM o0)
SELECT round(kappa, 6) AS kappa, round(po, 6) AS agreement, n, (SELECT (count(*) FILTER (abs(draw) >= abs(kappa) * (1 - 1e-9)) + 1) / (count(draw) + 1.0)::DOUBLE FROM n) AS p_value FROM o""")
def kappa_permutation(spark, d):
    rows = judged(spark, d).withColumn("second", (F.col("n_chars") > 1000).cast("int"))
    return rounded(I.kappa_permutation(rows, "quality", "second", ["doc_id"], 1000), "kappa", "agreement")


@query(f"""WITH z AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, {_rank('o_totalprice')} AS rx, {_rank('o_custkey')} AS ry FROM orders),
m AS {_shuffled('FROM z', 'o_orderkey', 'ry', 200)}, c AS (SELECT b, corr(z.rx, m.ry) AS draw FROM m JOIN z ON m.k = z.i GROUP BY 1), o AS (SELECT corr(rx, ry) AS s, count(*) AS n FROM z)
SELECT round(s, 6) AS spearman, n, (SELECT (count(*) FILTER (abs(draw) >= abs(s) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM c) AS p_value FROM o""")
def mantel_entries(spark, d):
    """Entries permuted, as for pairs that are no full triangle."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("y"))
    return rounded(I.mantel_entries(rows, "o_totalprice", "y", ["o_orderkey"], 200), "spearman")


def _block(own: str, other: str, name: str) -> str:
    return f"""SELECT '{name}' AS block, round(pow(max(c_y{own}), 2), 6) AS r2_alone, round(max(f) - pow(max(c_y{other}), 2), 6) AS r2_unique, round(max(f), 6) AS r2_full, round(avg(draw), 6) AS reference_mean, round(quantile_cont(draw, 0.025), 6) AS reference_ci_low,
round(quantile_cont(draw, 0.975), 6) AS reference_ci_high, round(max(f) - pow(max(c_y{other}), 2) - avg(draw), 6) AS excess, ((count(*) FILTER (draw >= f - pow(c_y{other}, 2) - 1e-9 * abs(f - pow(c_y{other}, 2))) + 1) / (count(*) + 1.0))::DOUBLE AS p_value
FROM (SELECT m.rep, any_value(f) AS f, any_value(c_ya) AS c_ya, any_value(c_yb) AS c_yb, (pow(corr(j.y, m.v), 2) + pow(corr(j.y, j.{other}), 2) - 2 * corr(j.y, m.v) * corr(j.y, j.{other}) * corr(m.v, j.{other})) / (1 - pow(corr(m.v, j.{other}), 2)) - pow(corr(j.y, j.{other}), 2) AS draw
FROM (SELECT b AS rep, v, k FROM {_shuffled(f'SELECT i AS o, {own} AS v FROM j', 'o', 'v', 1000)}) m JOIN j ON m.k = j.i, o GROUP BY 1)"""


@query(f"""WITH j AS (SELECT n_chars AS y, quality AS a, toxic AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM ({_JUDGED})),
o AS (SELECT corr(y, a) AS c_ya, corr(y, b) AS c_yb, (pow(corr(y, a), 2) + pow(corr(y, b), 2) - 2 * corr(y, a) * corr(y, b) * corr(a, b)) / (1 - pow(corr(a, b), 2)) AS f FROM j)
{_block('a', 'b', 'quality')} UNION ALL {_block('b', 'a', 'toxicity')}""")
def block_shares(spark, d):
    """What two blocks of columns explain of a length, alone and beside each other, with the reference of shuffled blocks."""
    out = A.block_reference(judged(spark, d), "doc_id", "n_chars", {"quality": ["quality"], "toxicity": ["toxic"]}, 1000)
    return rounded(out, "r2_alone", "r2_unique", "r2_full", "reference_mean", "reference_ci_low", "reference_ci_high", "excess")


@query()
def probe_reference(spark, d):
    """A probe of a class against its reference of shuffled labels, subjects being cases."""
    rows = views(spark, d, "full").withColumn("y", (F.col("label") < 5).cast("int"))
    found = P.probe_reference(rows, "y", "case_id", "case_id", 200)
    return rounded(found, *(c for c, t in found.dtypes if t == "double" and c != "p_raw"), digits=3)


@query()
def map_budget_sweep(spark, d):
    """Retention through affine maps fitted on nested prefixes of the training cases."""
    rows = labelled(spark, d, "va", "vb")
    out = P.map_budgets(rows.filter("part = 'train'"), rows.filter("part = 'test'"), ["y"], "va", "vb", [64, 128, 256])
    return rounded(out, "auroc", "oracle_auroc", "retention", "chance_corrected", digits=4)


_LINK = """c AS (SELECT least(c_nationkey, s) AS lo, greatest(c_nationkey, s) AS hi, c_acctbal AS v FROM (SELECT c_nationkey, (c_nationkey * 7 + c_custkey) % 25 AS s, c_acctbal FROM customer) WHERE c_nationkey <> s),
a AS (SELECT 'mknn' AS metric, lo, hi, avg(v) AS x FROM c GROUP BY ALL UNION ALL SELECT 'cka', lo, hi, max(v) FROM c GROUP BY ALL),
s0 AS (SELECT least(s_nationkey, t) AS lo, greatest(s_nationkey, t) AS hi, s_acctbal AS v FROM (SELECT s_nationkey, (s_nationkey * 7 + s_suppkey) % 25 AS t, s_acctbal FROM supplier) WHERE s_nationkey <> t),
r AS (SELECT 'anchor' AS route, 256 AS budget, lo, hi, 'p' || (lo % 2) AS op, avg(v) AS retention, min(v) AS chance_corrected FROM s0 GROUP BY ALL),
b AS (SELECT route, metric, budget, op, lo, hi, x, unnest(['retention', 'chance_corrected']) AS outcome, unnest([retention, chance_corrected]) AS y FROM a JOIN r USING (lo, hi)),
l AS (SELECT route, 'all_pairs' AS level, metric, budget, '' AS op, outcome, lo, hi, x, y FROM b UNION ALL SELECT route, 'objective_pair', metric, budget, op, outcome, lo, hi, x, y FROM b WHERE metric = 'mknn')"""
_G = "route, level, metric, budget, op, outcome"


_STATS = f"""{_LINK}, u AS (SELECT DISTINCT {_G}, unnest([lo, hi]) AS unit FROM l), k AS (SELECT l.*, unit FROM l JOIN u USING ({_G}) WHERE lo <> unit AND hi <> unit),
k2 AS (SELECT {_G}, unit, {_rank('x', _G + ', unit')} AS rx, {_rank('y', _G + ', unit')} AS ry FROM k), j AS (SELECT {_G}, unit, corr(rx, ry) AS v FROM k2 GROUP BY ALL HAVING count(*) >= 4 AND isfinite(corr(rx, ry))),
e AS (SELECT {_G}, CASE WHEN count(*) >= 3 THEN sqrt((count(*) - 1) / count(*) * var_pop(v) * count(*)) END AS std, count(*) AS n_units FROM j GROUP BY ALL),
p AS (SELECT {_G}, corr(rx, ry) AS rho FROM (SELECT {_G}, {_rank('x', _G)} AS rx, {_rank('y', _G)} AS ry FROM l) GROUP BY ALL),
n AS (SELECT {_G}, count(*) AS n_pairs, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM l GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT route, level, metric, budget AS n_anchors, op AS objective_pair, outcome, rho, slope, r2 AS r_squared, n_pairs, std, n_units FROM n JOIN p USING ({_G}) LEFT JOIN e USING ({_G}))"""


@query(f"""WITH {_STATS} SELECT * REPLACE (round(rho, 6) AS rho, round(slope, 6) AS slope, round(r_squared, 6) AS r_squared, round(std, 6) AS std) FROM s""")
def link_statistics(spark, d):
    """Agreement against retention by metric, budget, objective pair and outcome."""
    return rounded(C.link_statistics(C.link_rows(*_links(spark, d), "mknn")), "rho", "slope", "r_squared", "std")


@query(f"""WITH {_STATS}, z AS (SELECT *, CASE WHEN std > 0 THEN abs(rho) / std END AS z FROM s),
t AS (SELECT *, CASE WHEN z IS NOT NULL THEN 1 - 2 / sqrt(2 * pi()) * z / 12000 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 4000, 2) / 2))) END AS p_raw FROM z),
q AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN p_raw * count(p_raw) OVER f / count(p_raw) OVER (f ORDER BY p_raw) END AS q FROM t WINDOW f AS (PARTITION BY route, level, metric, outcome)),
h AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY route, level, metric, outcome, p_raw IS NULL ORDER BY p_raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE END AS p_fdr FROM q),
m AS (SELECT *, route = 'anchor' AND level = 'all_pairs' AND metric = 'mknn' AND n_anchors = 256 AND outcome = 'retention' AS main FROM h)
SELECT route, level, metric, n_anchors::INT AS n_anchors, objective_pair, outcome, round(rho, 6) AS rho, n_pairs, round(p_raw, 6) AS p_raw, round(p_fdr, 6) AS p_fdr, CASE WHEN main THEN 'primary' ELSE '' END AS role,
main AND coalesce(coalesce(p_fdr, p_raw) < 0.05, false) AND rho > 0 AND r_squared > 0 AS meets_rule FROM m""")
def link_table(spark, d):
    """The link with its pre-specified decision. The twin integrates the normal density."""
    found = C.link_table(*_links(spark, d), ("anchor", "mknn", 256))
    return rounded(found.select("route", "level", "metric", "n_anchors", "objective_pair", "outcome", "rho", "n_pairs", "p_raw", "p_fdr", "role", "meets_rule"), "rho", "p_raw", "p_fdr")


def _links(spark, d):
    """Agreement and retention of pairs of nations."""
    pair = lambda a, b: (F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).cast("int").alias("b"), F.col("c_acctbal").alias("v")).filter("a <> b").select(*pair("a", "b"), "v")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).cast("int").alias("b"), F.col("s_acctbal").alias("v")).filter("a <> b").select(*pair("a", "b"), "v")
    by = ["pair_lo", "pair_hi"]
    alignment = c.groupBy(*by).agg(F.avg("v").alias("alignment")).withColumn("metric", F.lit("mknn")).unionByName(c.groupBy(*by).agg(F.max("v").alias("alignment")).withColumn("metric", F.lit("cka")))
    kept = s.groupBy(*by).agg(F.avg("v").alias("retention"), F.min("v").alias("chance_corrected")).select(F.lit("anchor").alias("route"), F.lit(256).alias("n_anchors"), *by, F.concat(F.lit("p"), F.col("pair_lo") % 2).alias("objective_pair"), "retention", "chance_corrected")
    return alignment, kept


@query("""WITH m AS (SELECT c_nationkey, max(c_acctbal) AS y, log10(count(*)) AS p, (c_nationkey % 7)::DOUBLE AS t, log10(c_nationkey % 5 + 1) AS w FROM customer GROUP BY 1),
l AS (SELECT 'alignment_vs_log_params_given_width' AS analysis, p AS x, y, w AS z FROM m UNION ALL SELECT 'alignment_vs_year_given_width', t, y, w FROM m),
f AS (SELECT analysis, regr_slope(x, z) AS sx, regr_intercept(x, z) AS ix, regr_slope(y, z) AS sy, regr_intercept(y, z) AS iy FROM l GROUP BY 1), e AS (SELECT analysis, 'log10(embedding_width)' AS control, x - (ix + sx * z) AS x, y - (iy + sy * z) AS y FROM l JOIN f USING (analysis)
UNION ALL SELECT 'alignment_vs_log_width', 'none', w, y FROM m UNION ALL SELECT 'log_params_vs_log_width', 'none', w, p FROM m),
r AS (SELECT analysis, control, (rank() OVER (PARTITION BY analysis ORDER BY x) + (count(*) OVER (PARTITION BY analysis, x) - 1) / 2.0)::DOUBLE AS rx, (rank() OVER (PARTITION BY analysis ORDER BY y) + (count(*) OVER (PARTITION BY analysis, y) - 1) / 2.0)::DOUBLE AS ry FROM e)
SELECT analysis, control, count(*) AS n_encoders, round(corr(rx, ry), 5) AS rho FROM r GROUP BY ALL""")
def width_control(spark, d):
    nation = F.col("c_nationkey")
    e = table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("alignment"), F.log10(F.count("*").cast("double")).alias("log_params"))
    return rounded(C.width_control(e.withColumn("year", (nation % 7).cast("double")).withColumn("log_width", F.log10((nation % 5 + 1).cast("double")))), "rho", digits=5)


@query(f"""SELECT 'skin__c__' || vec_id AS case_id, 'skin_c' AS dataset, 'skin' AS modality, 'train' AS split, vec_id::VARCHAR AS image_key, 'c' AS image_subdir, {', '.join(f"(label = {k})::INT::DOUBLE AS kind{k}" for k in range(10))}
FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id::VARCHAR) AS r FROM embeddings) WHERE r <= 20""")
def class_pool(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *((F.col("label") == k).cast("int").alias(f"C{k}") for k in range(10)))
    return C.class_pool(e, "skin_c", "vec_id", {f"C{k}": f"kind{k}" for k in range(10)}, 20, 42, "c")


@query("""SELECT 'graded__' || o_orderkey AS case_id, o_custkey AS subject_id, CASE WHEN o_orderstatus = 'O' THEN 'valid' ELSE 'train' END AS split, CASE WHEN o_orderkey % 3 = 1 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN 0.0 END::DOUBLE AS edema,
CASE WHEN o_orderkey % 3 = 1 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN 0.0 END::DOUBLE AS side__effusion__left, (o_orderkey % 5)::DOUBLE AS grade__congestion, left(o_orderpriority, 1) AS reader_id FROM orders""")
def graded_pool(spark, d):
    key = F.col("o_orderkey")
    master = table(spark, d, "orders").select(
        key.alias("image_id"), F.lit("x.png").alias("img_rel_path"), F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "O", "VAL").otherwise("Train").alias("split"), F.lit(50).alias("age"), F.lit("f").alias("gender"),
        F.lit("pa").alias("view"), F.lit("2020").alias("study_date"), F.left("o_orderpriority", F.lit(1)).alias("reader"), (key % 3).alias("oedema"), (key % 3).alias("effusion_left_binary"), (key % 5).cast("string").alias("congestion"),
    )
    return C.graded_pool(master, "graded", {"oedema": "edema"}, ["effusion"], ["congestion", "absent"], "reader").select("case_id", "subject_id", "split", "edema", "side__effusion__left", "grade__congestion", "reader_id")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'mimic' ELSE 'chexpert' END AS dataset, 'k' || doc_id AS image_key, lang AS split, CASE WHEN doc_id % 3 <> 0 THEN 'r/' || doc_id || '.txt' ELSE ' ' END AS rel, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' ELSE ' ' || lang END AS f,
CASE WHEN doc_id % 5 < 3 THEN '' ELSE source END AS i, CASE WHEN doc_id % 7 = 0 THEN 'None' ELSE 'whole ' || doc_id END AS report FROM documents),
s AS (SELECT *, concat_ws(chr(10), CASE WHEN lower(trim(f)) NOT IN ('', 'nan', 'none') THEN trim(f) END, CASE WHEN lower(trim(i)) NOT IN ('', 'nan', 'none') THEN trim(i) END) AS joined, CASE WHEN lower(trim(report)) <> 'none' THEN trim(report) END AS other FROM p WHERE dataset = 'chexpert' AND doc_id % 11 <> 0)
SELECT 'c' || doc_id AS case_id, dataset, image_key, split, '/x/' || rel AS report_path, NULL::VARCHAR AS report_text, 'mimic_report_file' AS report_source FROM p WHERE dataset = 'mimic' AND trim(rel) <> '' AND doc_id % 13 <> 0
UNION ALL SELECT 'c' || doc_id, dataset, image_key, split, NULL, CASE WHEN joined <> '' THEN joined ELSE other END, CASE WHEN joined <> '' THEN 'findings+impression' ELSE 'report' END FROM s WHERE joined <> '' OR other IS NOT NULL""")
def paired_reports(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    pool = docs.select(F.concat(F.lit("c"), n).alias("case_id"), F.when(n % 2 == 0, "mimic").otherwise("chexpert").alias("dataset"), F.concat(F.lit("k"), n).alias("image_key"), F.col("lang").alias("split"), F.when(n % 3 != 0, F.concat(F.lit("r/"), n, F.lit(".txt"))).otherwise(" ").alias("report_rel_path"))
    plus = docs.filter("doc_id % 11 <> 0").select(
        F.concat(F.lit("k"), n).alias("image_key"), F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "nan").otherwise(F.concat(F.lit(" "), "lang")).alias("findings"), F.when(n % 5 < 3, "").otherwise(F.col("source")).alias("impression"),
        F.when(n % 7 == 0, "None").otherwise(F.concat(F.lit("whole "), n)).alias("report"),
    )
    files = docs.filter("doc_id % 13 <> 0").select(F.concat(F.lit("file:///x/r/"), n, F.lit(".txt")).alias("path"))
    return C.paired_reports(pool, plus.union(plus), ["findings", "impression"], "/x", files)


_LEVELS = """SELECT id, attribute || '|' || level AS finding FROM (SELECT *, min(n) OVER (PARTITION BY attribute) AS least FROM (SELECT *, row_number() OVER (PARTITION BY attribute, level ORDER BY md5('0|' || id), id) AS r, count(*) OVER (PARTITION BY attribute, level) AS n
FROM (SELECT vec_id AS id, 'parity' AS attribute, (label % 2)::VARCHAR AS level FROM embeddings UNION ALL SELECT vec_id, 'third', (vec_id % 3)::VARCHAR FROM embeddings))) WHERE r <= least"""


def _tested(attribute: str) -> str:
    """DuckDB: one row of the tests of an attribute, from w (attribute, level, pair, v)."""
    own = f"SELECT level, pair, v FROM w WHERE attribute = '{attribute}'"
    f = lambda by, source: f"(SELECT {by}(sum(c * m * m) - sum(c * m) ** 2 / sum(c)) / (count(*) - 1) / (sum(c * s) / (sum(c) - count(*))) AS f FROM (SELECT {by}level, count(*) AS c, avg(v) AS m, var_pop(v) AS s FROM {source} GROUP BY ALL) {'GROUP BY ' + by.rstrip(', ') if by else ''})"
    return f"""SELECT '{attribute}' AS attribute, r AS observed_range, g AS n_groups, rm AS reference_mean, lo AS reference_ci_low, hi AS reference_ci_high, pr AS p_reference, r - rm AS excess, f, pg AS p_groups FROM
(SELECT max(m) - min(m) AS r, count(*) AS g FROM (SELECT level, avg(v) AS m FROM ({own}) GROUP BY 1)) o,
(SELECT avg(draw) AS rm, quantile_cont(draw, 0.025) AS lo, quantile_cont(draw, 0.975) AS hi, (count(*) FILTER (draw >= (SELECT max(m) - min(m) FROM (SELECT level, avg(v) AS m FROM ({own}) GROUP BY 1)) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE AS pr FROM (SELECT b, max(m) - min(m) AS draw FROM (
  SELECT b, g, avg(v) AS m FROM (SELECT b, v, row_number() OVER (PARTITION BY b, pair ORDER BY md5('0|' || b || '|' || pair || '|' || level), level) AS g FROM ({own}), unnest(range(0, 50)) t(b)) GROUP BY ALL) GROUP BY 1)) d,
{f('', f'({own})')} x, (SELECT (count(*) FILTER (y.f >= x.f * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE AS pg FROM {f('b, ', f"(SELECT z.b, z.v, e.level FROM {_shuffled(own, 'level, pair', 'v', 50)} z JOIN (SELECT *, row_number() OVER (ORDER BY level, pair) - 1 AS i FROM ({own})) e ON z.k = e.i)")} y, {f('', f'({own})')} x) q"""


@query(f"""WITH {_knn_among(_LEVELS, 'finding', ('full', 'va', 'vb'), 5)}, w AS (SELECT split_part(g, '|', 1) AS attribute, split_part(g, '|', 2) AS level, ea || '|' || eb AS pair, avg(overlap) AS v FROM o GROUP BY ALL),
t AS ({_tested('parity')} UNION ALL {_tested('third')}), q AS (SELECT *, p_reference * 2 / row_number() OVER (ORDER BY p_reference, attribute) AS qr, p_groups * 2 / row_number() OVER (ORDER BY p_groups, attribute) AS qg FROM t),
h AS (SELECT *, least(1.0, min(qr) OVER (ORDER BY p_reference, attribute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS p_reference_fdr, least(1.0, min(qg) OVER (ORDER BY p_groups, attribute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS p_groups_fdr FROM q)
SELECT attribute, round(observed_range, 6) AS observed_range, n_groups, round(reference_mean, 6) AS reference_mean, round(reference_ci_low, 6) AS reference_ci_low, round(reference_ci_high, 6) AS reference_ci_high, round(p_reference, 6) AS p_reference, round(excess, 6) AS excess,
round(f, 6) AS f, round(p_groups, 6) AS p_groups, round(p_reference_fdr, 6) AS p_reference_fdr, round(p_groups_fdr, 6) AS p_groups_fdr, p_groups_fdr < 0.05 AS significant_fdr05 FROM h""")
def demographic_tests(spark, d):
    """Agreement of three views by class parity and by thirds, with its reference."""
    cases = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), (F.col("label") % 2).alias("parity"), (F.col("vec_id") % 3).alias("third"))
    found = C.demographic_tests(C.demographic_agreement(views(spark, d, "full", "va", "vb").drop("label"), cases, ["parity", "third"], 5), 50)
    return rounded(found, *(c for c, t in found.dtypes if t == "double"))


@query(f"""WITH {_knn_among("SELECT vec_id AS id, 'f' || (label % 3) AS finding FROM embeddings", 'finding', ('full', 'va', 'vb'), 5)}, m AS (SELECT g, ea, eb, avg(overlap) AS m FROM o GROUP BY ALL HAVING count(*) >= 20)
SELECT g AS finding, round(avg(m), 6) AS gold_alignment, count(*) AS n_pairs FROM m GROUP BY 1""")
def gold_agreement(spark, d):
    gold = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.concat(F.lit("f"), F.col("label") % 3).alias("finding"))
    return rounded(C.gold_agreement(views(spark, d, "full", "va", "vb").drop("label"), gold, 5), "gold_alignment")


_RUNS = """r AS (SELECT n_nationkey AS n, m, CASE n_nationkey % 5 WHEN 0 THEN 'frame_cxr' WHEN 1 THEN 'half_a' WHEN 2 THEN 'half_b' ELSE 'cxr' END AS arm,
  CASE WHEN n_nationkey % 5 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'image_text_shuffled' ELSE 'image_text' END ELSE CASE n_nationkey % 2 WHEN 0 THEN 'ssl' ELSE 'sup' END END AS level,
  CASE WHEN n_nationkey % 4 < 2 THEN 'dinov3' ELSE 'random' END AS init, 'seed' || (n_nationkey // 5) % 4 AS seed FROM nation JOIN (SELECT c_nationkey, avg(c_acctbal) / 10000 AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey),
q AS (SELECT *, concat_ws('__', arm, level, 'vit_s', init, seed) AS id FROM r),
p AS (SELECT a.id AS run_id_a, b.id AS run_id_b, CASE WHEN a.arm LIKE 'half%' AND b.arm LIKE 'half%' THEN 'E5_disjoint' ELSE 'E5' END AS experiment, (a.m + b.m) / 2 AS v,
  a.arm AS arm_a, b.arm AS arm_b, a.level AS level_a, b.level AS level_b, a.init AS init_a, b.init AS init_b, a.seed AS seed_a, b.seed AS seed_b FROM q a JOIN q b ON a.n < b.n)"""
_INIT = """l AS (SELECT *, arm_a || '/vit_s' AS setting, unnest(list_filter([
  CASE WHEN init_a <> init_b AND level_a = level_b THEN 'same_objective_across_initializations' END, CASE WHEN init_a <> init_b AND level_a <> level_b THEN 'different_objectives_across_initializations' END,
  CASE WHEN init_a = 'random' AND init_b = 'random' THEN 'different_objectives_both_random' END, CASE WHEN init_a = 'dinov3' AND init_b = 'dinov3' AND level_a = level_b AND seed_a <> seed_b THEN 'same_objective_seed_pairs_both_dinov3' END,
  CASE WHEN init_a = 'dinov3' AND init_b = 'dinov3' AND level_a <> level_b THEN 'different_objectives_both_dinov3' END], lambda x: x IS NOT NULL)) AS contrast FROM p WHERE experiment = 'E5' AND arm_a IN (SELECT arm_a FROM p WHERE experiment = 'E5' AND init_a <> init_b))"""
_ROWS_OF = """u AS (SELECT DISTINCT contrast, setting, unnest([run_id_a, run_id_b]) AS unit FROM l), j AS (SELECT contrast, setting, unit, avg(v) AS s FROM l JOIN u USING (contrast, setting) WHERE run_id_a <> unit AND run_id_b <> unit GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT contrast, setting, CASE WHEN count(*) >= 3 THEN sqrt((count(*) - 1) * var_pop(s)) END AS std, count(*) AS n FROM j GROUP BY ALL), c AS (SELECT contrast, setting, count(*) AS n_cells FROM u GROUP BY ALL),
g AS (SELECT contrast, setting, avg(v) AS m, count(*) AS n_pairs, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL)
SELECT contrast, setting, round(m, 6) AS alignment, n_pairs, n_cells, round(lo, 6) AS min_raw, round(hi, 6) AS max_raw, round(CASE WHEN n_pairs >= 4 THEN std END, 6) AS crossed_std, coalesce(e.n, 0) AS crossed_n_cells FROM g JOIN c USING (contrast, setting) LEFT JOIN e USING (contrast, setting)"""


def _matrix(spark, d):
    """Pairs of runs in the shape of a controlled matrix: a run for each nation."""
    n = F.col("n_nationkey")
    means = table(spark, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("m"))
    arm = F.when(n % 5 == 0, "frame_cxr").when(n % 5 == 1, "half_a").when(n % 5 == 2, "half_b").otherwise("cxr")
    level = F.when(n % 5 == 0, F.when(n % 3 == 0, "image_text_shuffled").otherwise("image_text")).otherwise(F.when(n % 2 == 0, "ssl").otherwise("sup"))
    seed = F.concat(F.lit("seed"), (F.floor(n / 5) % 4).cast("string"))
    runs = table(spark, d, "nation").join(means, n == F.col("c_nationkey")).select("n_nationkey", "m", arm.alias("arm"), F.concat_ws("__", arm, level, F.lit("vit_s"), F.when(n % 4 < 2, "dinov3").otherwise("random"), seed).alias("id"))
    one, other = (runs.select(F.col("n_nationkey").alias(f"n{s}"), F.col("id").alias(f"run_id_{s}"), F.col("arm").alias(f"arm{s}"), F.col("m").alias(f"m{s}")) for s in "ab")
    pairs = one.join(other, F.col("na") < F.col("nb"))  # few runs
    experiment = F.when(F.startswith("arma", F.lit("half")) & F.startswith("armb", F.lit("half")), "E5_disjoint").otherwise("E5")
    return C.run_pairs(pairs.select("run_id_a", "run_id_b", experiment.alias("experiment"), ((F.col("ma") + F.col("mb")) / 2).alias("mknn")))


def _contrast_rows(long):
    return rounded(C.contrast_rows(long).drop("crossed_ci_low", "crossed_ci_high"), "alignment", "min_raw", "max_raw", "crossed_std")


@query(f"WITH {_RUNS}, {_INIT}, {_ROWS_OF}")
def matrix_initialization(spark, d):
    return _contrast_rows(C.initialization_pairs(_matrix(spark, d)))


@query(f"""WITH {_RUNS}, {_INIT}, f AS (SELECT *, contrast LIKE 'same_obj%' AS same FROM l WHERE contrast LIKE '%across_init%'), u AS (SELECT DISTINCT setting, unnest([run_id_a, run_id_b]) AS unit FROM f),
j AS (SELECT setting, unit, avg(v) FILTER (same) - avg(v) FILTER (NOT same) AS s FROM f JOIN u USING (setting) WHERE run_id_a <> unit AND run_id_b <> unit GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT setting, CASE WHEN count(s) >= 3 THEN sqrt((count(s) - 1) * var_pop(s)) END AS std, count(s) AS n FROM j GROUP BY 1), g AS (SELECT setting, avg(v) FILTER (same) - avg(v) FILTER (NOT same) AS d, count(*) FILTER (same) AS a, count(*) FILTER (NOT same) AS b FROM f GROUP BY 1)
SELECT setting, round(d, 6) AS difference, round(CASE WHEN a + b >= 4 THEN std END, 6) AS crossed_std, a AS n_pairs_a, b AS n_pairs_b, n AS crossed_n_cells FROM g JOIN e USING (setting) WHERE a > 0 AND b > 0""")
def matrix_difference(spark, d):
    found = C.initialization_difference(C.initialization_pairs(_matrix(spark, d)))
    return rounded(found.select("setting", "difference", "crossed_std", "n_pairs_a", "n_pairs_b", "crossed_n_cells"), "difference", "crossed_std")


@query(f"""WITH {_RUNS}, l AS (SELECT *, 'cxr_disjoint/vit_s' AS setting, CASE WHEN arm_a = arm_b AND seed_a <> seed_b THEN 'within_half_different_seed' WHEN arm_a <> arm_b AND seed_a <> seed_b THEN 'across_halves_different_seed' WHEN arm_a <> arm_b THEN 'across_halves_same_seed' END AS contrast FROM p WHERE experiment = 'E5_disjoint' AND (arm_a <> arm_b OR seed_a <> seed_b)), {_ROWS_OF}""")
def matrix_disjoint(spark, d):
    return _contrast_rows(C.disjoint_pairs(_matrix(spark, d)))


@query(f"""WITH {_RUNS}, k AS (SELECT *, 'frame_cxr/vit_s' AS setting, level_a = 'image_text' AS na, level_b = 'image_text' AS nb FROM p WHERE arm_a = 'frame_cxr' AND level_a LIKE 'image_text%' AND level_b LIKE 'image_text%'),
l AS (SELECT * FROM (SELECT *, CASE WHEN na AND nb AND seed_a <> seed_b THEN 'natural_seed_pairs' WHEN na <> nb THEN CASE WHEN na THEN level_b ELSE level_a END || CASE WHEN seed_a <> seed_b THEN '_vs_natural_different_seed' ELSE '_vs_natural_same_seed' END END AS contrast FROM k) WHERE contrast IS NOT NULL), {_ROWS_OF}""")
def matrix_content(spark, d):
    return _contrast_rows(C.content_pairs(_matrix(spark, d)))


@query(f"""WITH {_RUNS}, s AS (SELECT arm_a AS arm, level_a AS level, avg(v) AS seed_pair_agreement FROM p WHERE init_a = 'dinov3' AND init_b = 'dinov3' AND level_a = level_b AND seed_a <> seed_b GROUP BY ALL)
SELECT 'cell_to_initialization' AS contrast, arm || '/vit_s' AS setting, level, round(avg(m), 6) AS alignment, count(*) AS n_cells, round(min(m), 6) AS min_raw, round(max(m), 6) AS max_raw, round(any_value(seed_pair_agreement), 6) AS seed_pair_agreement FROM r LEFT JOIN s USING (arm, level) GROUP BY ALL""")
def matrix_retention(spark, d):
    pairs = _matrix(spark, d)
    n = F.col("n_nationkey")
    cells = table(spark, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("mknn")).withColumnRenamed("c_nationkey", "n_nationkey")
    arm = F.when(n % 5 == 0, "frame_cxr").when(n % 5 == 1, "half_a").when(n % 5 == 2, "half_b").otherwise("cxr")
    level = F.when(n % 5 == 0, F.when(n % 3 == 0, "image_text_shuffled").otherwise("image_text")).otherwise(F.when(n % 2 == 0, "ssl").otherwise("sup"))
    found = C.retention_rows(pairs, cells.select(arm.alias("arm_group"), F.lit("vit_s").alias("backbone"), level.alias("axis_level"), "mknn"))
    return rounded(found, "alignment", "min_raw", "max_raw", "seed_pair_agreement")


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS g FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT *, coalesce((g >= 2)::INT, 0) AS y FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || id), id) AS r, (SELECT min(c) FROM (SELECT count(*) AS c FROM l GROUP BY y)) AS least FROM l)
SELECT 'fundus__ord__' || id AS case_id, 'fundus_ord' AS dataset, 'fundus' AS modality, 'test' AS split, id || '.png' AS image_key, 'ord' AS image_subdir, y::DOUBLE AS referable_dr, g::DOUBLE AS dr_grade, 'ord' AS source_tag FROM r WHERE r <= least(500, least)""")
def fundus_pool(spark, d):
    n = F.col("o_orderkey")
    master = table(spark, d, "orders").select("o_orderkey", F.when(n % 7 == 0, "none").otherwise((n % 5).cast("string")).alias("grade"), (F.col("o_orderstatus") != "P").cast("int").alias("gradable"))
    return C.fundus_pool(master, "ord", "o_orderkey", "grade", 500, "test", gradable="gradable", suffix=".png")


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'valid' ELSE 'train' END AS split, CASE WHEN p_partkey % 3 = 0 THEN 'VAL' ELSE 'TRAIN' END AS folder, 'K' || p_size % 6 AS c, 'img' || p_partkey AS stem FROM part WHERE p_partkey % 13 <> 0),
t AS (SELECT *, 'tis__' || split || '_' || c || '_' || stem AS case_id FROM f WHERE c <> 'K5'), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('42|' || case_id), case_id) AS r FROM t)
SELECT case_id, 'tis' AS dataset, 'histo' AS modality, split, folder || '/' || c || '/' || stem || '.tif' AS image_key, NULL::VARCHAR AS image_subdir, c AS tissue_class, (c = 'K1')::INT::DOUBLE AS tumor_label FROM r WHERE r <= 150""")
def tissue_pool(spark, d):
    """Files by split and class, of which some are of another kind and one class is not asked for."""
    n = F.col("p_partkey")
    name = F.concat(F.lit("img"), n, F.when(n % 13 == 0, ".txt").otherwise(".tif"))
    files = table(spark, d, "part").select(F.concat_ws("/", F.lit("file:///data"), F.when(n % 3 == 0, "VAL").otherwise("TRAIN"), F.concat(F.lit("K"), F.col("p_size") % 6), name).alias("path"))
    return C.tissue_pool(files, "tis", {"TRAIN": "train", "VAL": "valid"}, [f"K{k}" for k in range(5)], 150, ["K1"])


@query("""WITH m AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 10 <> 9)
SELECT 'acq__' || i AS case_id, 'acq' AS dataset, 'cxr' AS modality, 'a/' || o_orderkey AS image_key, CASE o_orderstatus WHEN 'F' THEN 'valid' ELSE lower(o_orderstatus) END AS split, o_custkey AS subject_id, o_orderpriority AS institution,
CASE o_orderkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'mixed: a + b' ELSE 'solo' END AS manufacturer, CASE WHEN o_orderkey % 2 = 0 THEN 'AP' ELSE 'PA' END AS view, trim(o_orderpriority || ' ' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END) AS report_text FROM m WHERE o_orderkey % 11 <> 0""")
def acquisition_pool(spark, d):
    """Images with lists of makers, foreign modalities and views, and some without an institution."""
    n = F.col("o_orderkey")
    master = table(spark, d, "orders").select(
        F.concat(F.when(n % 2 == 0, "../../").otherwise(""), F.lit("a/"), n).alias("ImagePath"), F.when(F.col("o_orderstatus") == "F", "VAL").otherwise(F.col("o_orderstatus")).alias("split"), F.col("o_custkey").alias("subject_id"), F.when(n % 11 != 0, F.col("o_orderpriority")).alias("institution"),
        F.when(n % 3 == 0, "one").when(n % 3 == 1, "['b', 'a']").otherwise(" ['solo'] ").alias("manufacturer"), F.when(n % 4 == 3, "LL").when(n % 2 == 0, "AP").otherwise("PA").alias("view"), F.when(n % 10 == 9, "CT").otherwise("DX").alias("ImageModality"),
        F.col("o_orderpriority").alias("findings"), F.when(n % 6 != 0, F.col("o_orderstatus")).alias("impression"), "o_orderkey",
    )
    return C.acquisition_pool(master, "acq", ["o_orderkey"], ["findings", "impression", "absent"])


_LADDER = "SELECT o_orderpriority AS step, o_totalprice / 600000 AS auroc_transfer, CASE WHEN o_orderkey % 9 <> 0 THEN 0.3 + (o_orderkey % 40) / 100.0 END AS reference_ci_high, 0.45 + (o_custkey % 50) / 100.0 AS auroc_oracle, CASE WHEN o_orderkey % 8 <> 0 THEN (o_custkey % 100) / 1000.0 END AS p_fdr, 100 + o_custkey % 3 AS n_perm FROM orders"


@query(f"""WITH l AS (SELECT *, auroc_transfer / auroc_oracle AS retention, CASE WHEN auroc_oracle > 0.5 THEN (auroc_transfer - 0.5) / (auroc_oracle - 0.5) END AS c FROM ({_LADDER}))
SELECT step, count(*) AS n_pairs, round(avg((auroc_transfer > reference_ci_high)::INT), 6) AS share_above_reference_p975, round(avg(coalesce((p_fdr < 0.05)::INT, 0)), 6) AS share_significant_fdr, round(1.0 / (max(n_perm) + 1), 6)::DOUBLE AS min_attainable_p,
round(median(auroc_transfer), 6) AS median_transfer_auroc, round(median(auroc_oracle), 6)::DOUBLE AS median_oracle_auroc, round(median(retention), 6) AS median_retention, round(median(c), 4) AS median_retention_chance_corrected FROM l GROUP BY 1""")
def ladder_summary(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    oracle = F.lit(0.45) + (c % 50) / 100.0
    ladder = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("step"), (F.col("o_totalprice") / 600000).alias("auroc_transfer"), F.when(k % 9 != 0, F.lit(0.3) + (k % 40) / 100.0).alias("reference_ci_high"), oracle.alias("auroc_oracle"),
        (F.col("o_totalprice") / 600000 / oracle).alias("retention"), F.when(k % 8 != 0, (c % 100) / 1000.0).alias("p_fdr"), (F.lit(100) + c % 3).alias("n_perm"),
    )
    found = C.transfer_summary(C.with_transfer_columns(ladder))
    return rounded(rounded(found, "share_above_reference_p975", "share_significant_fdr", "min_attainable_p", "median_transfer_auroc", "median_oracle_auroc", "median_retention"), "median_retention_chance_corrected", digits=4)


_TRANSFER = """SELECT o_orderpriority AS finding, 'e' || o_custkey % 3 AS enc_train, 'e' || o_orderkey % 3 AS enc_eval, 'g' || o_custkey % 2 AS objective_train, 'g' || o_orderkey % 2 AS objective_eval, CASE o_orderstatus WHEN 'F' THEN 256 ELSE 1024 END AS n_anchors,
o_totalprice / 600000 AS auroc_xenc, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 500000 END AS retention, CASE WHEN o_orderkey % 5 <> 0 THEN 0.3 + (o_custkey % 30) / 100.0 END AS refit_anchor_b64, 0.2 + (o_custkey % 60) / 100.0 AS refit_native_b64 FROM orders"""


def _levels_sql() -> str:
    rows = []
    for level, cols in (("finding", ["finding"]), ("encoder_pair", ["enc_train", "enc_eval"]), ("objective_pair", ["objective_train", "objective_eval"]), ("anchor_budget", ["n_anchors"])):
        where = "" if level == "anchor_budget" else " WHERE n_anchors = 1024"
        for comparator, v in (("NULL", "retention"), ("'refit_anchor'", "auroc_xenc - refit_anchor_b64"), ("'refit_native'", "auroc_xenc - refit_native_b64")):
            rows.append(f"""SELECT '{level}' AS level, concat_ws('|', {', '.join(f'{c}::VARCHAR' for c in cols)}) AS "group", {comparator}::VARCHAR AS comparator, {v} AS v FROM t{where}""")
    return " UNION ALL ".join(rows)


@query(f"""WITH t AS ({_TRANSFER}), l AS (SELECT * FROM ({_levels_sql()}) WHERE v IS NOT NULL), k AS (SELECT *, dense_rank() OVER (ORDER BY level, "group", comparator) AS gid FROM l),
i AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY gid) AS n, avg(v) OVER (PARTITION BY gid) AS point FROM k),
d AS (SELECT gid, b, h * n >> 32 AS p FROM {mixed_sql("SELECT gid, n, b, i AS j FROM i, unnest(range(0, 100)) t(b)", 0, 'b', '0', 'j')}), r AS (SELECT d.gid, b, avg(v) AS draw, any_value(point) AS point FROM d JOIN i ON d.gid = i.gid AND d.p = i.i GROUP BY ALL),
s AS (SELECT gid, stddev_samp(draw) AS std, quantile_cont(draw, 0.025) AS lo, quantile_cont(draw, 0.975) AS hi, greatest(avg((abs(draw - point) >= abs(point) * (1 - 1e-9))::INT), 0.01) AS p FROM r GROUP BY 1),
g AS (SELECT gid, any_value(level) AS level, any_value("group") AS "group", any_value(comparator) AS comparator, any_value(point) AS point, count(*) AS n FROM i GROUP BY 1), j AS (SELECT *, CASE WHEN comparator IS NOT NULL THEN p END AS p_raw FROM g JOIN s USING (gid) WHERE comparator IS NULL OR n >= 5),
q AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN p_raw * count(p_raw) OVER f / count(p_raw) OVER (f ORDER BY p_raw) END AS q FROM j WINDOW f AS (PARTITION BY level, comparator))
SELECT level, "group", comparator, round(point, 6) AS mean, n, round(std, 6) AS std, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p_raw, 6)::DOUBLE AS p_raw,
CASE WHEN p_raw IS NOT NULL THEN round(least(1.0, min(q) OVER (PARTITION BY level, comparator ORDER BY p_raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE END AS p_fdr FROM q""")
def paired_summaries(spark, d):
    """Transfer against refits on 64 labels by finding, pairs and anchors, on orders in the role of results."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    named = lambda letter, n, of: F.concat(F.lit(letter), (of % n).cast("string"))
    transfer = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("finding"), named("e", 3, c).alias("enc_train"), named("e", 3, k).alias("enc_eval"), named("g", 2, c).alias("objective_train"), named("g", 2, k).alias("objective_eval"),
        F.when(F.col("o_orderstatus") == "F", 256).otherwise(1024).alias("n_anchors"), (price / 600000).alias("auroc_xenc"), F.when(k % 7 != 0, price / 500000).alias("retention"), F.when(k % 5 != 0, F.lit(0.3) + (c % 30) / 100.0).alias("refit_anchor_b64"), (F.lit(0.2) + (c % 60) / 100.0).alias("refit_native_b64"),
    )
    found = C.paired_summaries(transfer, [64, 999], 1024, replicates=100).drop("label_budget")
    return rounded(found, "mean", "std", "ci_low", "ci_high", "p_raw", "p_fdr")


@query()
def acquisition_predictability(spark, d):
    """Class parity and class group told from vectors, in their own space and in that of 64 anchors."""
    e = table(spark, d, "embeddings")
    cases = e.select(F.col("vec_id").alias("case_id"), F.floor(F.col("vec_id") / 2).alias("subject"), F.concat(F.lit("m"), F.col("label") % 2).alias("maker"), F.concat(F.lit("i"), F.col("label") % 5).alias("institution"))
    anchors = S.capped(e.select(F.col("vec_id").alias("case_id")), 64, 1, "case_id").withColumn("pos", F.col("case_id"))
    found = C.acquisition_predictability(views(spark, d, "full").drop("label"), cases, ["maker", "institution"], "subject", anchors)
    return rounded(found, "accuracy", "ci_low", "ci_high", "majority_baseline", "accuracy_above_baseline", digits=4)


def _panel(spark, d):
    """Three views, and two encoders of which one lacks every third vector and one two of three."""
    v = views(spark, d, "full", "va", "vb", "floor_a", "floor_b").drop("label")
    gone = ((F.col("encoder") == "floor_a") & (F.col("case_id") % 10 == 0)) | ((F.col("encoder") == "floor_b") & (F.col("case_id") % 3 != 0))
    return v.withColumn("embedding", F.when(~gone, F.col("embedding")))


@query("""SELECT e AS encoder, round(CASE e WHEN 'floor_a' THEN avg((vec_id % 10 <> 0)::INT) WHEN 'floor_b' THEN avg((vec_id % 3 = 0)::INT) WHEN 'absent' THEN 0 ELSE 1 END, 6)::DOUBLE AS finite_row_fraction,
CASE e WHEN 'floor_b' THEN 'SKIPPED_MOSTLY_NAN' WHEN 'absent' THEN 'MISSING' ELSE 'USED' END AS status FROM embeddings, (VALUES ('full'), ('va'), ('floor_a'), ('floor_b'), ('absent')) t(e) GROUP BY e""")
def consensus_audit(spark, d):
    return rounded(C.consensus_audit(_panel(spark, d), ["full", "va", "floor_a", "floor_b", "absent"]), "finite_row_fraction")


@query()
def consensus_build(spark, d):
    """Residuals of four encoders of five, the spread of their consensus and the mean deviation of cases."""
    anchors = S.capped(table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id")).filter("case_id % 10 <> 0"), 24, 1, "case_id").withColumn("pos", F.col("case_id"))
    found = C.consensus(_panel(spark, d), anchors, ["full", "va", "vb", "floor_a", "floor_b"])
    size = found.vectors.agg(F.sum(V.dot(F.col("embedding"), F.col("embedding"))).alias("size"), F.count("*").alias("n_cases"))
    deviation = found.deviations.agg(F.avg("deviation").alias("mean_deviation"))
    return rounded(found.residuals.select("encoder", "residual", "iterations", "converged").crossJoin(size).crossJoin(deviation), "residual", "size", "mean_deviation", digits=4)  # one row each
