"""Queries of sources, sinks, units and column helpers: fixtures are written through the sinks and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.functions import numbers as N
from concord.operators import agreement as A
from concord.operators import inference as I
from concord.operators import vectors as V
from concord.operators.order import positions
from concord.plans import units as U
from concord.plans.catalogue import query, table
from concord.plans.geometry import _view, views
from concord.plans.statistics import judged, rounded
from concord.sources import npz as Z
from concord.sources import tables as S
from concord.sources.shared import shared_dir


@query("""SELECT c_custkey, 'é, "' || c_name || '"' AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def csv_scan(spark, d):
    """A CSV that is not UTF-8, with quotes and separators in its cells."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('é, "'), "c_name", F.lit('"')).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    path = shared_dir(spark)
    S.write_csv(rows, path, encoding="ISO-8859-1")
    return S.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("""SELECT n_nationkey, n_name FROM nation""")
def csv_sniffed(spark, d):
    path = shared_dir(spark)
    S.write_csv(table(spark, d, "nation").coalesce(1), path, sep=";")
    return S.read_sniffed_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name")


@query("""SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events WHERE event_id % 3 <> 0""")
def jsonl_scan(spark, d):
    """JSON lines of which every third is broken."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    line = F.to_json(F.struct("event_id", "event_type", "value"), {"ignoreNullFields": "false"})
    path = shared_dir(spark)
    rows.select(F.when(F.col("event_id") % 3 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double")[0]


@query("""SELECT n_malformed FROM (SELECT count(*) FILTER (event_id % 3 = 0) AS n_malformed FROM events)""")
def jsonl_malformed(spark, d):
    rows = table(spark, d, "events").select("event_id")
    line = F.to_json(F.struct("event_id"))
    path = shared_dir(spark)
    rows.select(F.when(F.col("event_id") % 3 == 0, F.left(line, F.lit(5))).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long")[1]


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def jsonl_by_prefix(spark, d):
    """JSON lines of the folders whose names begin alike."""
    path = shared_dir(spark)
    for status, name in (("F", "part_f"), ("P", "part_p"), ("O", "other")):
        S.write_jsonl(table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"), f"{path}/{name}")
    return S.read_jsonl(spark, f"{path}/part_*", "o_orderkey long, o_orderstatus string")[0]


@query("""SELECT DISTINCT upper(trim(replace(substr(lpad(p_partkey::VARCHAR, 6, '0') || rpad(left(p_brand, 3) || '.' || p_size, 8, ' ') || p_name, 7, 8), '.', ''))) AS code FROM part WHERE length(p_name) >= 1""")
def fixed_width_codes(spark, d):
    p = table(spark, d, "part").filter("length(p_name) >= 1")
    path = shared_dir(spark)
    p.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.rpad(F.concat(F.left("p_brand", F.lit(3)), F.lit("."), F.col("p_size").cast("string")), 8, " "), "p_name").alias("value")).write.text(path)
    return S.read_codes(spark, path)


@query("""SELECT 'label=' || label AS class, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY label""")
def directory_classes(spark, d):
    """The rows of files below folders that are named after their class."""
    path = shared_dir(spark)
    table(spark, d, "embeddings").select("label", "vec_id").write.partitionBy("label").parquet(path)
    files = S.list_files(spark, path, "*.parquet").select("class", F.regexp_replace("path", "^[a-z]+:/*", "/").alias("at"))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).select("vec_id", F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/").alias("of"))
    return rows.join(files, F.col("of") == F.col("at")).groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN 'file of ' || n_name WHEN n_nationkey % 2 = 0 THEN 'table of ' || n_name END AS report FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0""")
def report_files(spark, d):
    """The text of a file where there is one, else that of the table; without either a row drops out."""
    path = shared_dir(spark)
    n = table(spark, d, "nation")
    n.filter("n_nationkey % 3 <> 0").select(F.concat(F.lit("file of "), "n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(path)
    files = S.list_files(spark, path, "*.txt").select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("k"), "path")
    rows = n.join(files, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", F.coalesce("path", F.lit("/none")).alias("at"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("table of "), "n_name")).otherwise(" ").alias("text"))
    found = S.report_texts(spark, rows, "at", "text", f"{path}/*")
    return found.select("n_nationkey", F.regexp_replace("report", "\n$", "").alias("report"))  # the text writer ends a line


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1""")
def unit_runner(spark, d):
    """Two runs of a resumable table: the second computes only the units that the first lacks."""
    path = f"{shared_dir(spark)}/units"
    orders = table(spark, d, "orders").select("o_orderstatus", "o_custkey")
    units = orders.select("o_orderstatus").distinct()
    compute = lambda left: orders.join(left, "o_orderstatus", "left_semi")
    U.run_units(units.filter("o_orderstatus = 'F'"), compute, path, {"v": 1}, "o_orderstatus")
    return U.run_units(units, compute, path, {"v": 1}, "o_orderstatus").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS parameter, count(*) <> count(*) FILTER (c_acctbal > -900) OR max(c_custkey) <> max(c_custkey) FILTER (c_acctbal > -900) AS moved FROM customer GROUP BY 1 UNION ALL SELECT 'rate', false""")
def moved_parameters(spark, d):
    """The parameters in which a written table differs from what is wanted now: here what it was built from, by segment."""
    path = f"{shared_dir(spark)}/table"
    customers = table(spark, d, "customer")
    built = lambda df: {r.s: [r.n, r.last] for r in df.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("last")).collect()} | {"rate": float("nan")}
    now = built(customers)
    S.write_table(customers, path, params=built(customers.filter("c_acctbal > -900")))
    moved = S.moved_params(spark, path, now)
    return spark.createDataFrame([(k, k in moved) for k in now], "parameter string, moved boolean")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'F' WHEN 'view' THEN 'M' ELSE event_type END AS sex, CASE WHEN user_id % 90 <> 0 THEN (user_id % 90)::DOUBLE END AS age, CASE WHEN event_id % 3 <> 0 THEN 'AP' WHEN event_id % 2 = 0 THEN 'PA' END AS view FROM events""")
def subject_metadata(spark, d):
    e = table(spark, d, "events")
    sex = F.when(F.col("event_type") == "click", "Female").when(F.col("event_type") == "view", "Male").otherwise(F.col("event_type"))
    position, view = F.when(F.col("event_id") % 3 != 0, "AP").otherwise("nan"), F.when(F.col("event_id") % 2 == 0, "PA").otherwise(" ")
    return e.select("event_id", *L.subject_columns(sex, (F.col("user_id") % 90).cast("string"), position, view, zero_is_missing=True))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 2 = 0)::INT::DOUBLE END AS has_a, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 2 = 0 AND doc_id % 3 <> 0)::INT::DOUBLE END AS only_a FROM documents""")
def category_lists(spark, d):
    n = F.col("doc_id")
    cell = F.when(n % 9 == 0, F.lit(None).cast("string")).when((n % 2 == 0) & (n % 3 == 0), "['a', 'b']").when(n % 2 == 0, "['a']").otherwise("['b']")
    return table(spark, d, "documents").select("doc_id", L.has_category(cell, "a").alias("has_a"), L.only_category(cell, "a").alias("only_a"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 2 THEN 1.0 WHEN o_orderkey % 5 = 1 THEN 0.0 END::DOUBLE AS severe, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 0.0 END::DOUBLE AS right_only FROM orders""")
def label_builders(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", L.severity((n % 5).cast("string")).alias("severe"), L.laterality(n % 2, n % 3).alias("right_only"))


@query("""SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey AND a.n_nationkey % 2 = b.n_nationkey % 2 THEN 'same_objective' WHEN a.n_regionkey = b.n_regionkey THEN 'within_family' ELSE 'across_family' END AS kind FROM nation a JOIN nation b ON a.n_name < b.n_name""")
def pair_kinds(spark, d):
    """Kind of every pair of a panel."""
    n = table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("family"), (F.col("n_regionkey") * 2 + F.col("n_nationkey") % 2).alias("objective"))
    pairs = U.panel_pairs(n, "n_name")
    side = lambda s: n.select(F.col("n_name").alias(s), F.col("family").alias(f"f{s}"), F.col("objective").alias(f"o{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", N.pair_kind(F.col("oa"), F.col("ob"), F.col("fa"), F.col("fb")).alias("kind"))


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name""")
def panel_permutations(spark, d):
    return U.panel_pairs(table(spark, d, "nation"), "n_name", "n_regionkey", ordered=True)


@query("""SELECT arm || '__' || level || '__' || seed AS run_id FROM (SELECT DISTINCT c_mktsegment AS arm FROM customer), (SELECT DISTINCT o_orderpriority AS level FROM orders), (SELECT n_name AS seed FROM nation) WHERE NOT (arm = 'BUILDING' AND level = '5-LOW')
EXCEPT SELECT c_mktsegment || '__' || o_orderpriority || '__' || n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 470000""")
def run_enumeration(spark, d):
    """Runs of a design, segments by priorities by nations, that no large order has done yet."""
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    axis = lambda df, col: sorted(r[0] for r in df.select(col).distinct().collect())  # a design's axes are short
    every = U.runs({"arm": axis(c, "c_mktsegment"), "level": axis(o, "o_orderpriority"), "seed": axis(n, "n_name")}, spark, lambda r: (r["arm"], r["level"]) != ("BUILDING", "5-LOW"))
    done = o.filter("o_totalprice > 470000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return U.missing_members(every, done.select(F.concat_ws("__", "c_mktsegment", "o_orderpriority", "n_name").alias("run_id")), "run_id")


@query(f"""SELECT e AS encoder, id AS case_id, len(v)::INT AS width FROM (SELECT * FROM ({_view('full')}) UNION ALL SELECT * FROM ({_view('va')})) WHERE id % 10 <> 3""")
def consensus_cases(spark, d):
    """Vectors of the cases that every encoder has; one encoder lacks a tenth."""
    v = views(spark, d, "full", "va").drop("label").filter("encoder = 'full' OR case_id % 10 <> 3")
    return A.usable_encoders(v, v.select("case_id")).select("encoder", "case_id", F.size("embedding").alias("width"))


@query(f"""WITH x AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM ({_view('full')})), n AS (SELECT greatest(1, count(*)) AS n FROM x), t AS (SELECT reader, doc_id % n AS a, (doc_id * 7) % n AS b, (doc_id * 11) % n AS c, CASE WHEN (doc_id + reader) % 2 = 0 THEN 'b' ELSE 'c' END AS choice FROM documents, n, (VALUES (1), (2)) r(reader)),
z AS (SELECT reader, choice, 1 - list_inner_product(x.v, y.v) AS db, 1 - list_inner_product(x.v, w.v) AS dc FROM t JOIN x ON x.id = t.a JOIN x y ON y.id = t.b JOIN x w ON w.id = t.c)
SELECT reader::INT AS reader, count(*) AS n, round(avg((choice = CASE WHEN db < dc THEN 'b' ELSE 'c' END)::INT), 6) AS agreement FROM z WHERE abs(db - dc) >= 1e-9 GROUP BY 1""")
def triplet_readers(spark, d):
    """How often two readers' choices agree with the nearer vector, their answers united; endpoints are places in the order of ids."""
    n = F.col("doc_id")
    docs, x = table(spark, d, "documents"), positions(views(spark, d, "full"), ["case_id"], "at").drop("case_id").withColumnRenamed("at", "case_id")
    most = max(1, x.count())
    answers = None
    for reader in (1, 2):
        one = docs.select(F.lit(reader).alias("reader"), (n % most).alias("a"), (n * 7 % most).alias("b"), (n * 11 % most).alias("c"), F.when((n + reader) % 2 == 0, "b").otherwise("c").alias("choice"))
        answers = one if answers is None else answers.unionByName(one)
    found = V.triplet_choice(answers, x)
    return rounded(found.groupBy("reader").agg(F.count("*").alias("n"), F.avg((F.col("choice") == F.col("nearer")).cast("double")).alias("agreement")), "agreement")


@query("""SELECT event_type, round(avg(value), 6) AS point, round(avg(value) - stddev_samp(value), 6) AS ci_low, round(avg(value) + stddev_samp(value), 6) AS ci_high FROM events GROUP BY 1""")
def interval_brackets(spark, d):
    """Intervals that hold their points pass the assertion unchanged."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("point"), (F.avg("value") - F.stddev_samp("value")).alias("ci_low"), (F.avg("value") + F.stddev_samp("value")).alias("ci_high"))
    return rounded(I.bracketed(e, "point", "ci_low", "ci_high"), "point", "ci_low", "ci_high")


@query("""WITH r AS (SELECT c_nationkey, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS before, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS after FROM customer GROUP BY 1),
g AS (SELECT avg(after - before) AS gain, stddev_samp(after - before) AS sd, avg(before) AS base, count(*)::DOUBLE AS n FROM r WHERE before IS NOT NULL AND after IS NOT NULL), t AS (SELECT *, abs(gain / (sd / sqrt(n))) AS t, n - 1 AS k FROM g),
w AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / k, -(k + 1) / 2) AS y FROM t, unnest(range(0, 4001)) u(i)),
p AS (SELECT 1 - 2 * exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / sqrt(k * pi()) * (SELECT sum(y) FROM w) * t / 12000 AS p FROM t)
SELECT round(gain, 4) AS gain, round(p, 6) AS p_value, p < 0.05 AND gain > 0.01 * abs(base) AS passed FROM t, p""")
def paired_gate(spark, d):
    """The gate of a paired gain: balances of two halves of each nation's customers. The twin integrates Student's density."""
    half = lambda k: F.avg(F.when(F.col("c_custkey") % 2 == k, F.col("c_acctbal")))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(half(0).alias("before"), half(1).alias("after"))
    r = I.paired_gain(rows, "before", "after")
    return spark.createDataFrame([(round(r["gain"], 4), None if r["p_value"] is None else round(r["p_value"], 6), r["passed"])], "gain double, p_value double, passed boolean")


@query("""SELECT vec_id::VARCHAR AS case_id, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings""")
def npz_rows(spark, d):
    """Vectors written as npz archives and read back by row ranges."""
    path = shared_dir(spark)
    Z.write_npz(table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding"), path)
    rows = Z.read_npz_rows(spark, path, ["case_id", "embedding"], range_bytes=1 << 16)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("case_id", F.size("embedding").alias("width"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(total, 5).alias("total"))


@query("""SELECT name, count(*) AS n_rows, CASE name WHEN 'embeddings' THEN 64 ELSE 0 END::BIGINT AS width, name = 'ids' AS compressed FROM embeddings, (VALUES ('case_ids'), ('embeddings')) t(name) GROUP BY name""")
def npz_shapes(spark, d):
    """Shapes of archives, from their headers."""
    path = shared_dir(spark)
    Z.write_npz(table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding").repartition(3), path)
    return Z.shapes(spark, path).groupBy("name", F.coalesce("width", F.lit(0)).cast("long").alias("width"), "compressed").agg(F.sum("n_rows").alias("n_rows"))


@query("""SELECT doc_id, length(coalesce(text, '')) AS n_letters, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS n_e FROM documents""")
def encoded_texts(spark, d):
    """Texts through the hook of outside encoders, here one that counts."""
    found = V.encoded(table(spark, d, "documents"), "text", lambda texts: [(len(t or ""), (t or "").count("e")) for t in texts], ["doc_id"])
    return found.select("doc_id", F.col("embedding")[0].cast("long").alias("n_letters"), F.col("embedding")[1].cast("long").alias("n_e"))


@query("""SELECT r_name AS region, CASE WHEN count(s_suppkey) FILTER (s_acctbal > 9000) > 0 THEN 'valid' ELSE 'not ready' END AS state, count(s_suppkey) FILTER (s_acctbal > 9000) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def table_states(spark, d):
    """Tables of rich suppliers by region: finished ones are valid, those without rows are not ready."""
    s = table(spark, d, "supplier").filter("s_acctbal > 9000").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path, out = shared_dir(spark), []
    for r in table(spark, d, "region").collect():
        params, at = {"region": r.r_name}, f"{path}/{r.r_regionkey}"
        own = s.filter(F.col("n_regionkey") == r.r_regionkey)
        try:
            S.write_table(own, at, params=params)
            out.append((r.r_name, "valid" if S.is_valid(spark, at, params) and not S.is_valid(spark, at, {"region": ""}) else "moved", spark.read.parquet(at).count()))
        except S.NotReady:
            out.append((r.r_name, "not ready", 0))
    return spark.createDataFrame(out, "region string, state string, n long")


@query("""SELECT n_name AS nation, '/data/' || r_name || '/' || n_nationkey || '/${absent}' AS folder FROM nation JOIN region ON n_regionkey = r_regionkey""")
def resolved_folders(spark, d):
    """A configuration of all nations whose values name others."""
    n, r = table(spark, d, "nation").collect(), table(spark, d, "region").collect()
    config = {"root": "/data", "regions": {f"r{x.r_regionkey}": {"name": x.r_name, "folder": f"${{root}}/${{regions.r{x.r_regionkey}.name}}"} for x in r}}
    config["nations"] = {x.n_name: f"${{regions.r{x.n_regionkey}.folder}}/{x.n_nationkey}/${{absent}}" for x in n}
    return spark.createDataFrame(sorted(U.resolved(config)["nations"].items()), "nation string, folder string")


@query("""WITH j AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT l.doc_id, n_chars::DOUBLE AS n_chars FROM labels l JOIN documents USING (doc_id))),
d AS (SELECT b, ('0x' || substr(md5('0|' || b || '|' || i), 1, 15))::BIGINT % n AS k FROM j, unnest(range(0, 50)) t(b)) SELECT b::INT AS b, round(median(n_chars) - avg(n_chars), 6) AS draw FROM d JOIN j ON d.k = j.i GROUP BY b""")
def bootstrap_any(spark, d):
    """A statistic that is no sum, of the rows of each replicate: the median less the mean."""
    import pandas as pd

    rows = I.resampled(judged(spark, d).select("doc_id", "n_chars"), ["doc_id"], 50, 0)
    skew = lambda f: pd.DataFrame({"b": [int(f["b"].iloc[0])], "draw": [f["n_chars"].median() - f["n_chars"].mean()]})
    return rounded(I.by_replicate(rows, skew, "b int, draw double"), "draw")


@query()
def auroc_gaps(spark, d):
    """The range of AUROCs that sources of their class counts would show if all were alike."""
    rows = judged(spark, d)
    per = rows.groupBy("source").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("p"), F.count(F.when(F.col("quality") == 0, 1)).alias("q")).collect()
    overall = I.auroc(rows, "quality", "n_chars").first().auroc
    found = I.gap_reference(overall, [(r.p, r.q) for r in per])
    return rounded(spark.createDataFrame([tuple(found.values())], "reference_mean double, reference_std double, reference_ci_low double, reference_ci_high double, n_subgroups int"), "reference_mean", "reference_std", "reference_ci_low", "reference_ci_high")


@query("""SELECT n_regionkey, count(*) AS n_files, count(*) = min(c) AS one_digest FROM nation, (SELECT count(*) AS c, n_regionkey AS k FROM nation GROUP BY 2) WHERE k = n_regionkey GROUP BY 1""")
def digests_of_files(spark, d):
    """Files of a region hold the same text and so have one digest, which no other region's have."""
    path = shared_dir(spark)
    table(spark, d, "nation").select(F.concat(F.lit("region "), "n_regionkey").alias("value"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")).repartition("k").write.partitionBy("r", "k").text(path)
    region = F.regexp_extract("path", r"/r=(\d+)/", 1).cast("int")
    found = S.file_digests(spark, path, "*.txt").select(region.alias("n_regionkey"), "digest")
    of = found.groupBy("digest").agg(F.countDistinct("n_regionkey").alias("regions")).withColumnRenamed("digest", "_of")
    each = found.join(of, F.col("digest") == F.col("_of"))
    return each.groupBy("n_regionkey").agg(F.count("*").alias("n_files"), ((F.countDistinct("digest") == 1) & (F.max("regions") == 1)).alias("one_digest"))


@query("""SELECT r_name AS region, CASE WHEN count(n_nationkey) % 2 = 0 THEN 'unknown' WHEN min(n_nationkey) % 2 = 0 THEN 'current' ELSE 'stale' END AS state FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def stale_tables(spark, d):
    """Tables by region under a regime that their smallest nation gives; one with an even number of nations has no stage in the registry."""
    path, out = shared_dir(spark), []
    per = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("least"), F.count("*").alias("n"))
    for r in table(spark, d, "region").join(per, F.col("r_regionkey") == F.col("n_regionkey"), "left").collect():
        at = f"{path}/{r.r_regionkey}"
        S.write_table(table(spark, d, "region").filter(F.col("r_regionkey") == r.r_regionkey), at, params={"regime": (r.least or 0) % 2})
        regimes = {} if (r.n or 0) % 2 == 0 else {"regions": 0}
        out.append((r.r_name, "unknown" if not regimes else "current" if S.stale_reason(spark, at, "regions", regimes) is None else "stale"))
    return spark.createDataFrame(out, "region string, state string")


@query("""SELECT o_orderpriority || '/' || o_orderstatus || '.txt' AS path, CASE o_orderstatus WHEN 'F' THEN 'gone' WHEN 'O' THEN 'changed' ELSE 'new' END AS change FROM orders GROUP BY ALL""")
def files_that_changed(spark, d):
    """Listings of two folders by priority: files of one status are gone, others are longer, others new."""
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    tail = lambda df, p: df.withColumn("path", F.concat(F.regexp_replace(F.element_at(F.split("path", "/"), -3), "^p=", ""), F.lit("/"), F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^s=", ""), F.lit(".txt")))
    seen = []
    for kept, more in (("F|O", ""), ("O|P", " more")):
        path = shared_dir(spark)
        rows = o.filter(F.col("o_orderstatus").rlike(kept)).select(F.concat(F.col("n").cast("string"), F.lit(more)).alias("value"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
        rows.coalesce(1).write.partitionBy("p", "s").text(path)
        seen.append(tail(S.fingerprints(spark, path, "*.txt"), path))
    return S.changed_files(*seen)
