"""Queries of manifest algebra: decoding, keys, samples, joins, audits, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.functions import numbers as N
from concord.functions import text as X
from concord.operators import relational as R
from concord.operators import sampling as S
from concord.plans.catalogue import query, table


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 1 THEN 1.0::DOUBLE WHEN l_linenumber % 4 IN (0, 2) THEN 0.0::DOUBLE END AS label FROM lineitem""")
def label_decode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.decode_codes(F.col("l_linenumber") % 4, 1, (0, 2)).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CASE round_even(l_discount * 25, 0)::BIGINT WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN NULL WHEN 0 THEN 0.0::DOUBLE END AS label FROM lineitem""")
def label_decode_rounded(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.decode_presence(F.col("l_discount") * 25, 1, (0, 2), (2,)).alias("label"))


@query("""SELECT d.doc_id, greatest(l.quality, l.toxic)::DOUBLE AS finding, coalesce((l.quality >= 1)::INT, 0)::DOUBLE AS at_least_one FROM documents d LEFT JOIN labels l USING (doc_id)""")
def finding_max_merge(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", L.merge_findings(F.col("quality"), F.col("toxic")).cast("double").alias("finding"), L.at_least(F.col("quality"), 1).alias("at_least_one"))


@query("""SELECT doc_id, 'quality' AS finding, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels""")
def unpivot_findings(spark, d):
    return R.long_findings(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'nih_cxr14__' || regexp_replace(regexp_extract(trim(url), '[^/]*$'), '\.[^.]*$', '')
 WHEN 1 THEN 'padchest__' || regexp_replace(trim(url), '\.[^.]*$', '') ELSE 'vindr_cxr__' || trim(url) END AS case_id FROM pages""")
def case_id_build(spark, d):
    site = F.when(F.col("page_id") % 3 == 0, "nih_cxr14").when(F.col("page_id") % 3 == 1, "padchest").otherwise("vindr_cxr")
    return table(spark, d, "pages").select("page_id", X.case_id(site, F.col("url")).alias("case_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE n_chars::VARCHAR || '.5' END AS subdir FROM documents""")
def subdir_int_string(spark, d):
    raw = F.concat(F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".0").otherwise(".5"))
    return table(spark, d, "documents").select("doc_id", X.integral_text(raw).alias("subdir"))


@query("""SELECT page_id, CASE WHEN strpos(url, 'example') > 0 THEN '/data/' || substr(url, strpos(url, 'example')) ELSE url END AS path FROM pages""")
def path_rewrite(spark, d):
    return table(spark, d, "pages").select("page_id", X.rerooted(F.col("url"), "example", "/data").alias("path"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/r/CXR14/preprocessed224/' || source WHEN 1 THEN '/r/preprocessed224/' || lang || '/' || source
 WHEN 2 THEN '/r/preprocessed224/' || CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END || '/' || source || '.jpg' ELSE '/r/' || source END AS path FROM documents""")
def image_paths(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "nih_cxr14").when(F.col("doc_id") % 4 == 1, "padchest").when(F.col("doc_id") % 4 == 2, "vindr_cxr").otherwise("rexgradient")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    key = F.when(kind == "rexgradient", F.concat(F.lit("../../"), F.col("source"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", X.image_path(kind, F.lit("/r"), key, split, F.col("lang")).alias("path"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 50 > 0 AND c_acctbal / 50 <= 40 THEN '<40' WHEN c_acctbal / 50 > 40 AND c_acctbal / 50 <= 60 THEN '40-60'
 WHEN c_acctbal / 50 > 60 AND c_acctbal / 50 <= 80 THEN '60-80' WHEN c_acctbal / 50 > 80 AND c_acctbal / 50 <= 200 THEN '80+' END AS band FROM customer""")
def age_band(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.age_band(F.col("c_acctbal") / 50).alias("band"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS answer FROM orders""")
def yesno_parse(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "FALSE ").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", L.yes_no(said).alias("answer"))


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'adequate' WHEN '2' THEN 'suboptimal' WHEN '3' THEN 'non-diagnostic' WHEN '4' THEN '' ELSE o_orderpriority END AS quality FROM orders""")
def quality_prefix(spark, d):
    p = F.left("o_orderpriority", F.lit(1))
    said = F.when(p == "1", " Adequate view").when(p == "2", "SUBOPTIMAL").when(p == "3", "nondiagnostic").when(p == "4", None).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", L.image_quality(said).alias("quality"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'train' WHEN 'F' THEN 'valid' ELSE 'test' END AS split FROM orders""")
def split_normalise(spark, d):
    raw = F.when(F.col("o_orderstatus") == "P", "Train").when(F.col("o_orderstatus") == "F", "VAL").otherwise("test")
    return table(spark, d, "orders").select("o_orderkey", L.split_name(raw).alias("split"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN quality WHEN 1 THEN toxic END::DOUBLE AS value FROM labels""")
def row_dependent_lookup(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, "quality").when(F.col("doc_id") % 3 == 1, "toxic").otherwise("absent")
    return table(spark, d, "labels").select("doc_id", L.column_named_by(name, {"quality": F.col("quality"), "toxic": F.col("toxic")}).alias("value"))


def _sections_sql(rows: str) -> str:
    return f"""WITH s AS (SELECT conv_id, min(CASE WHEN role = 'system' THEN trim(text) END) AS a, min(CASE WHEN role = 'user' THEN trim(text) END) AS b, min(trim(text)) AS c FROM ({rows}) GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(nullif(a, ''), nullif(b, '')) IS NULL THEN coalesce(c, '') ELSE concat_ws(chr(10), nullif(a, ''), nullif(b, '')) END AS report FROM s"""


@query(_sections_sql("FROM conversations"))
def section_combine(spark, d):
    return _sections(table(spark, d, "conversations"))


_KINDS = "CASE doc_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE 'other' END"


@query(_sections_sql(f"SELECT doc_id // 3 AS conv_id, {_KINDS} AS role, substr(text, 1 + 11 * (doc_id % 2)::INT) AS text FROM documents"))
def section_combine_whole(spark, d):
    """Whole documents as sections, three to a report."""
    n = F.col("doc_id")
    role = F.when(n % 4 == 0, "system").when(n % 4 == 1, "user").otherwise("other")
    return _sections(table(spark, d, "documents").select(F.floor(n / 3).alias("conv_id"), role.alias("role"), F.expr("substr(text, cast(1 + 11 * (doc_id % 2) AS int))").alias("text")))


def _sections(turns):
    part = lambda r: F.min(F.when(F.col("role") == r, F.trim("text")))
    s = turns.groupBy("conv_id").agg(part("system").alias("a"), part("user").alias("b"), F.min(F.trim("text")).alias("c"))
    return s.select("conv_id", X.combined_sections(F.col("a"), F.col("b"), fallback=F.col("c")).alias("report"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'mixed: ' || least(p_brand, p_type) || ' + ' || greatest(p_brand, p_type) ELSE p_type END AS vendor FROM part""")
def vendor_parse(spark, d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("['"), "p_brand", F.lit("']"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("['"), "p_type", F.lit("', '"), "p_brand", F.lit("']"))).otherwise(F.concat(F.lit(" "), "p_type"))
    return table(spark, d, "part").select("p_partkey", X.vendor(cell).alias("vendor"))


@query("""WITH b AS (SELECT DISTINCT upper(trim(replace(p_brand, '.', ''))) AS c FROM part)
SELECT x.c AS code_a, y.c AS code_b, (length(x.c) + length(y.c) - 2 * list_max(list_filter(range(0, least(length(x.c), length(y.c)) + 1), lambda i: left(x.c, i) = left(y.c, i))))::INT AS distance FROM b x, b y""")
def code_tree_distance(spark, d):
    codes = table(spark, d, "part").select(X.normal_code(F.col("p_brand")).alias("code")).distinct()
    pairs = codes.select(F.col("code").alias("code_a")).crossJoin(codes.select(F.col("code").alias("code_b")))  # brands, not rows
    return pairs.select("code_a", "code_b", X.code_distance(F.col("code_a"), F.col("code_b")).cast("int").alias("distance"))


@query("""WITH n AS (SELECT n_name, CASE WHEN n_regionkey > 0 THEN r_name END AS g FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.n_name AS class_a, b.n_name AS class_b, CASE WHEN a.n_name = b.n_name THEN 0 WHEN a.g IS NOT DISTINCT FROM b.g THEN 1 ELSE 2 END AS distance FROM n a, n b""")
def taxonomy_distance(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.when(F.col("n_regionkey") > 0, F.col("r_name")).alias("g"))
    a, b = n.select(F.col("n_name").alias("class_a"), F.col("g").alias("ga")), n.select(F.col("n_name").alias("class_b"), F.col("g").alias("gb"))
    return a.crossJoin(b).select("class_a", "class_b", X.taxonomy_distance(F.col("class_a"), F.col("class_b"), F.col("ga"), F.col("gb")).alias("distance"))


@query("""SELECT least(c_nationkey, s_nationkey) AS pair_lo, greatest(c_nationkey, s_nationkey) AS pair_hi, round(avg(o_totalprice) * count(*) * 100)::BIGINT AS total_cents, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def pair_key_means(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer, supplier = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    means = R.pair_means(rows, "c_nationkey", "s_nationkey", "o_totalprice")
    return means.select("pair_lo", "pair_hi", F.round(F.col("mean_value") * F.col("n") * 100).cast("long").alias("total_cents"), "n")  # whole cents, free of rounding


@query("""SELECT o_orderkey, 'arm' || o_orderstatus AS arm, 'L' || o_custkey AS level, o_orderpriority AS backbone, NULL::VARCHAR AS seed FROM orders""")
def run_id_split(spark, d):
    run = F.concat_ws("__", F.concat(F.lit("arm"), "o_orderstatus"), F.concat(F.lit("L"), F.col("o_custkey").cast("string")), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", *X.key_parts(run, ["arm", "level", "backbone", "seed"]))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 > 0.5 THEN round((l_discount * 10 - 0.5) / (l_quantity / 50 - 0.5), 6) END AS corrected, round(l_discount * 100.0, 1) AS pct, CASE WHEN l_tax > 0 THEN round(log10(l_tax), 6) END AS log_tax FROM lineitem""")
def chance_corrected(spark, d):
    value, best = F.col("l_discount") * 10, F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.chance_corrected(value, best), 6).alias("corrected"), N.percent(F.col("l_discount")).alias("pct"), F.round(N.log10_positive(F.col("l_tax")), 6).alias("log_tax"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20""")
def cap_per_group(spark, d):
    return S.cap_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", 20, 42, "doc_id")


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r FROM labels WHERE quality IN (0, 1)),
m AS (SELECT CASE WHEN count(*) = 2 THEN min(c) ELSE 0 END AS least FROM (SELECT quality, count(*) AS c FROM labels WHERE quality IN (0, 1) GROUP BY 1))
SELECT doc_id, quality FROM r, m WHERE r <= 50 AND r <= least""")
def balanced_sample(spark, d):
    return S.balanced(table(spark, d, "labels").select("doc_id", "quality"), "quality", 50, 42, "doc_id")


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents WHERE lang IS NOT NULL) WHERE c >= 120 AND r <= 120""")
def matched_n_draw(spark, d):
    return S.matched_draw(table(spark, d, "documents").select("doc_id", "lang"), "lang", 120, 7, "doc_id")


@query("""SELECT doc_id FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 100""")
def capped_sample(spark, d):
    return S.capped(table(spark, d, "documents").select("doc_id"), 100, 3, "doc_id")


@query("""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50""")
def topn_head(spark, d):
    return S.head(table(spark, d, "documents").select("doc_id", "source"), 50, "doc_id")


@query("""WITH l AS (SELECT doc_id, 'lang' AS attribute, lang AS level FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
s AS (SELECT attribute, level, count(*) AS c FROM l WHERE level <> '' GROUP BY ALL), u AS (SELECT attribute, min(c) AS least FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
r AS (SELECT l.*, least, row_number() OVER (PARTITION BY attribute, level ORDER BY md5('5|' || doc_id), doc_id) AS r FROM l JOIN u USING (attribute) WHERE level <> '')
SELECT attribute, level, doc_id FROM r WHERE r <= least""")
def subgroup_draws(spark, d):
    return S.subgroup_draws(table(spark, d, "documents"), ["lang", "source"], 5, "doc_id")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey, sum(n) OVER (ORDER BY md5('42|' || o_custkey), o_custkey ROWS UNBOUNDED PRECEDING) - n AS before FROM s)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c WHERE before < 500)""")
def greedy_overshoot(spark, d):
    return S.take_until(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 500, 42)


@query("""WITH RECURSIVE c AS (SELECT o_orderstatus AS g, o_custkey AS u, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42|' || u), u) AS r FROM c),
t AS (SELECT g, 0::BIGINT AS r, 0::BIGINT AS taken, NULL::BIGINT AS u FROM (SELECT DISTINCT g FROM s)
UNION ALL SELECT s.g, s.r, CASE WHEN t.taken < 300 AND t.taken + s.n <= 300 THEN t.taken + s.n ELSE t.taken END, CASE WHEN t.taken < 300 AND t.taken + s.n <= 300 THEN s.u END FROM t JOIN s ON s.g = t.g AND s.r = t.r + 1)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM t WHERE t.g = o.o_orderstatus AND t.u = o.o_custkey)""")
def greedy_skip(spark, d):
    return S.take_fitting(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", 300, 42, "o_orderstatus")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS side, (ceil(l_quantity / 10) - 1)::INT AS grade FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY grade, side ORDER BY md5('0|' || id), id) AS r FROM r), m AS (SELECT grade, CASE WHEN count(*) = 2 THEN min(c) ELSE 0 END AS least FROM (SELECT grade, side, count(*) AS c FROM r GROUP BY ALL) GROUP BY 1)
SELECT id, side, grade FROM k JOIN m USING (grade) WHERE r <= least""")
def severity_matched_sides(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("side"), (F.ceil(F.col("l_quantity") / 10) - 1).cast("int").alias("grade"))
    return S.matched_sides(rows, "side", "grade", 0, "id").select("id", "side", "grade")


_SPLIT = """WITH u AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN r <= greatest(1, floor({share} * n)) THEN 'train' ELSE 'test' END AS part FROM orders JOIN u USING (o_custkey)"""


@query(_SPLIT.format(share=0.7))
def patient_disjoint_split(spark, d):
    return S.unit_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 42).select("o_orderkey", "part")


@query(_SPLIT.format(share=0.5))
def disjoint_halves(spark, d):
    return S.unit_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 42, 0.5).select("o_orderkey", "part")


@query("""WITH m AS (SELECT vec_id, label AS f FROM embeddings WHERE label < 4), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY md5('42|' || vec_id), vec_id) AS r FROM m),
rest AS (SELECT vec_id, 4 AS f, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS r FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM r WHERE r <= 25)),
b AS (SELECT * FROM r WHERE r <= 25 UNION ALL SELECT * FROM rest)
SELECT vec_id, (row_number() OVER (ORDER BY f, r) - 1)::INT AS pos FROM b ORDER BY f, r LIMIT 100""")
def anchor_selection(spark, d):
    e = table(spark, d, "embeddings")
    wide = e.select("vec_id", *((F.col("label") == k).cast("int").alias(f"f{k}") for k in range(4)))
    return S.anchors(wide, [f"f{k}" for k in range(4)], 100, 42, "vec_id").select("vec_id", F.col("pos").cast("int").alias("pos"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1993-01-01')""")
def heldout_anti_join(spark, d):
    o = table(spark, d, "orders")
    return R.held_out(o.select("o_orderkey", "o_custkey", "o_orderstatus"), o.filter("o_orderdate < '1993-01-01'"), "o_custkey", "o_orderstatus", ("O", "P")).select("o_orderkey", "o_custkey")


@query("""SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def complete_cases(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return R.complete(joined, ["quality", "toxic"]).select("doc_id")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1""")
def any_positive(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return R.any_positive(joined, ["quality", "toxic"]).select("doc_id")


@query("""SELECT doc_id, lang FROM documents WHERE source NOT IN ('src0', 'src1') OR (source = 'src0' AND lang IN ('en', 'de')) OR (source = 'src1' AND lang IN ('fr'))""")
def view_filter(spark, d):
    return R.keep_views(table(spark, d, "documents").select("doc_id", "lang", "source"), "source", "lang", {"src0": ["en", "de"], "src1": ["fr"], "src2": None}).select("doc_id", "lang")


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1)
SELECT c_custkey, o_orderkey AS first_order, o_totalprice FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def left_dedup_join(spark, d):
    orders = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return R.left_join_first(table(spark, d, "customer"), orders, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", F.col("o_orderkey").alias("first_order"), "o_totalprice")


@query("""SELECT a.doc_id, a.quality AS reader_1, (d.n_chars > 1000)::INT AS reader_2, (a.quality = (d.n_chars > 1000)::INT) AS agree FROM labels a JOIN documents d USING (doc_id)""")
def two_reader_join(spark, d):
    second = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("reader_2"))
    return table(spark, d, "labels").join(second, "doc_id").select("doc_id", F.col("quality").alias("reader_1"), "reader_2", (F.col("quality") == F.col("reader_2")).alias("agree"))


@query("""SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def nway_intersection(spark, d):
    return R.in_all(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""")
def same_group_pairs(spark, d):
    return R.same_group_pairs(table(spark, d, "nation"), "n_regionkey", "n_name")


_LABELLED = "(SELECT source, 'quality' AS finding, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT source, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")


@query(f"""SELECT finding, count(v) AS n_labeled, count(*) FILTER (v = 1) AS n_positive, count(*) FILTER (v = 0) AS n_negative, CASE WHEN count(v) > 0 THEN round(count(*) FILTER (v = 1) / count(v), 6) END AS prevalence FROM {_LABELLED} GROUP BY 1""")
def prevalence_by_finding(spark, d):
    return R.prevalence(_labelled(spark, d), ["quality", "toxic"])


@query(f"""SELECT finding, source, count(v) AS n_labeled, count(*) FILTER (v = 1) AS n_positive, count(*) FILTER (v = 0) AS n_negative, CASE WHEN count(v) > 0 THEN round(count(*) FILTER (v = 1) / count(v), 6) END AS prevalence FROM {_LABELLED} GROUP BY ALL""")
def prevalence_by_site(spark, d):
    return R.prevalence(_labelled(spark, d), ["quality", "toxic"], ["source"])


@query("""SELECT lang, count(*) FILTER (source = 'src0' AND quality = 1) AS src0, count(*) FILTER (source = 'src1' AND quality = 1) AS src1, count(*) FILTER (source = 'src2' AND quality = 1) AS src2 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def prevalence_pivot(spark, d):
    positive = F.count(F.when(F.col("quality") == 1, 1))
    return _labelled(spark, d).groupBy("lang").pivot("source", ["src0", "src1", "src2"]).agg(positive).fillna(0)


@query("""WITH p AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS f FROM orders), s AS (SELECT f, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT x.f AS fa, y.f AS fb, count(*) AS n FROM p x JOIN p y USING (c) GROUP BY ALL)
SELECT a.f AS finding_a, z.f AS finding_b, a.n AS n_positive_a, z.n AS n_positive_b, coalesce(b.n, 0) AS n_co_occurrence, a.n + z.n - coalesce(b.n, 0) AS n_union,
 CASE WHEN a.n + z.n - coalesce(b.n, 0) > 0 THEN round(coalesce(b.n, 0) / (a.n + z.n - coalesce(b.n, 0)), 6) ELSE 0 END AS jaccard FROM s a CROSS JOIN s z LEFT JOIN b ON fa = a.f AND fb = z.f""")
def comorbidity_jaccard(spark, d):
    return R.comorbidity(table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("finding")), "case_id", "finding")


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_splits FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def split_leak_audit(spark, d):
    return R.split_leaks(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_key_audit(spark, d):
    return R.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""SELECT source, max(c) / sum(c) AS largest_share FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY 1""")
def largest_share(spark, d):
    return R.largest_share(table(spark, d, "documents"), "lang", ["source"])


_PAIRS = "(SELECT p.a, p.b, s.v FROM (SELECT a.n_name AS a, b.n_name AS b, a.n_nationkey AS k, b.n_nationkey AS k2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name) p JOIN (SELECT x.c_nationkey AS k, y.c_nationkey AS k2, x.m - y.m AS v FROM (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) x, (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) y) s ON s.k = p.k AND s.k2 = p.k2)"


def nation_pairs(spark, d):
    """(a, b, v): nation pairs of a region with the difference of their mean balances, the fixture's pair table."""
    nation = table(spark, d, "nation")
    means = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    named = nation.join(means, F.col("n_nationkey") == F.col("c_nationkey"))
    pairs = R.same_group_pairs(nation, "n_regionkey", "n_name")
    one, two = named.select(F.col("n_name").alias("a"), F.col("m").alias("ma")), named.select(F.col("n_name").alias("b"), F.col("m").alias("mb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("ma") - F.col("mb")).alias("v"))


@query(f"""WITH p AS (SELECT * FROM {_PAIRS} WHERE NOT (a = 'FRANCE' OR b = 'FRANCE')), u AS (SELECT a AS member, v FROM p UNION ALL SELECT b, v FROM p) SELECT member, round(avg(v), 6) AS mean_value, count(*) AS n_pairs FROM u GROUP BY 1""")
def encoder_means_dropone(spark, d):
    out = R.member_means(nation_pairs(spark, d), "a", "b", "v", (F.col("a") == "FRANCE") | (F.col("b") == "FRANCE"))
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("""SELECT event_type, round(max(m) - min(m), 6) AS level_range, round(avg(s), 6) AS mean_within_std, count(*) AS n_levels FROM (SELECT event_type, user_id % 10 AS level, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY ALL) GROUP BY 1""")
def level_spread(spark, d):
    out = R.level_spread(table(spark, d, "events").withColumn("level", F.col("user_id") % 10), "level", "value", ["event_type"])
    return out.withColumn("level_range", F.round("level_range", 6)).withColumn("mean_within_std", F.round("mean_within_std", 6))


@query("""SELECT o_orderstatus, o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, 1.0::DOUBLE AS share_positive FROM orders GROUP BY ALL""")
def grouped_summary(spark, d):
    out = R.summaries(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.select("o_orderstatus", "o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "median", "q25", "q75")), "share_positive")


@query("""SELECT event_type, band, round(avg(value), 6) AS mean_value, count(*) AS n FROM (SELECT *, (user_id % 4)::VARCHAR AS band FROM events) GROUP BY GROUPING SETS ((event_type), (band), (event_type, band), ())""")
def grouping_sets_summary(spark, d):
    table(spark, d, "events").withColumn("band", (F.col("user_id") % 4).cast("string")).createOrReplaceTempView("concord_events")
    return spark.sql("SELECT event_type, band, round(avg(value), 6) AS mean_value, count(*) AS n FROM concord_events GROUP BY GROUPING SETS ((event_type), (band), (event_type, band), ())")


@query("""SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'a' WHEN embedding[2] >= embedding[3] THEN 'b' ELSE 'c' END AS class FROM embeddings""")
def argmax_class(spark, d):
    return table(spark, d, "embeddings").select("vec_id", L.argmax_class([F.col("embedding")[i] for i in range(3)], ["a", "b", "c"]).alias("class"))


@query("""SELECT vec_id, (label = 1)::INT AS label_1, (label = 2)::INT AS label_2, (label = 3)::INT AS label_3 FROM embeddings""")
def onehot_dropfirst(spark, d):
    return R.one_hot(table(spark, d, "embeddings"), "label", range(4)).select("vec_id", "label_1", "label_2", "label_3")


@query("""SELECT c_custkey::VARCHAR AS case_id, 'customer' AS dataset, NULL::DOUBLE AS age, c_mktsegment AS view FROM customer UNION ALL SELECT s_suppkey::VARCHAR, 'supplier', NULL, NULL FROM supplier""")
def union_and_conform(spark, d):
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("customer").alias("dataset"), F.col("c_mktsegment").alias("view"))
    two = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.lit("supplier").alias("dataset"))
    return R.conform(R.union_all(one, two), {"case_id": "string", "dataset": "string", "age": "double", "view": "string"})


@query("""SELECT doc_id, CASE WHEN source = 'src0' AND lang = 'en' THEN 'xx' ELSE lang END AS lang, CASE WHEN n_chars = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents""")
def conditional_patch(spark, d):
    fixes = [((F.col("source") == "src0") & (F.col("lang") == "en"), "lang", F.lit("xx")), (F.col("n_chars") == 0, "n_chars", F.lit(None).cast("long"))]
    return R.patched(table(spark, d, "documents"), fixes).select("doc_id", "lang", "n_chars")
