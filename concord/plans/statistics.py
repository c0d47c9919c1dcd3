"""Queries of resampling inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import inference as I
from concord.operators.resampling import drawn_sql, keys_sql
from concord.plans.catalogue import query, table
from concord.plans.manifest import _PAIRS, nation_pairs

B = 1000
#: Replicates of permutations; their twins sort all rows for each.
P = 1000


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def judged(spark, d):
    """Labelled documents with a second reading and a score."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "source")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    return rows.select("doc_id", "source", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), "n_chars")


_JUDGED = "SELECT l.doc_id, source, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, n_chars::DOUBLE AS n_chars FROM labels l JOIN documents USING (doc_id)"
def _drawn(order: str) -> str:
    """DuckDB: j, the labelled documents in an order with place i, and d, the places k that replicate b draws."""
    return f"j AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({_JUDGED})), d AS {drawn_sql(_JUDGED, order, B, 0)}"


_TAIL = "round(stddev_samp(draw), 6) AS std, round(quantile_cont(draw, 0.025), 6) AS ci_low, round(quantile_cont(draw, 0.975), 6) AS ci_high, count(draw) AS n_draws"


@query(f"""WITH {_drawn('quality')}, r AS (SELECT d.b, avg(quality) AS draw FROM d JOIN j ON d.k = j.i GROUP BY 1)
SELECT (SELECT round(avg(quality), 6) FROM j) AS point, (SELECT count(*) FROM j) AS n, {_TAIL} FROM r""")
def bootstrap_mean(spark, d):
    return rounded(I.bootstrap_mean(judged(spark, d), "quality", B), "point", "std", "ci_low", "ci_high")


_SOURCES = f"SELECT sum(toxic) AS s, count(*)::DOUBLE AS c FROM ({_JUDGED}) GROUP BY source"


@query(f"""WITH q AS (SELECT *, row_number() OVER (ORDER BY s, c) - 1 AS i FROM ({_SOURCES})), r AS (SELECT d.b, sum(s) / sum(c) AS draw FROM {drawn_sql(_SOURCES, 's, c', B, 0)} d JOIN q ON d.k = q.i GROUP BY 1)
SELECT (SELECT round(avg(toxic), 6) FROM ({_JUDGED})) AS point, (SELECT count(*) FROM ({_JUDGED})) AS n, {_TAIL} FROM r""")
def cluster_bootstrap(spark, d):
    return rounded(I.cluster_bootstrap_mean(judged(spark, d), "toxic", "source", B), "point", "std", "ci_low", "ci_high")


@query(f"""WITH {_drawn('quality - toxic')}, r AS (SELECT d.b, avg(quality - toxic) AS draw FROM d JOIN j ON d.k = j.i GROUP BY 1), o AS (SELECT avg(quality - toxic) AS point, count(*) AS n FROM j)
SELECT (SELECT round(point, 6) FROM o) AS point, (SELECT n FROM o) AS n, {_TAIL}, round(greatest(avg((abs(draw - (SELECT point FROM o)) >= abs((SELECT point FROM o)) * (1 - 1e-9))::INT), 1.0 / {B}), 6)::DOUBLE AS p_value FROM r""")
def paired_bootstrap(spark, d):
    return rounded(I.paired_bootstrap(judged(spark, d), "quality", "toxic", B), "point", "std", "ci_low", "ci_high", "p_value")


def _rank(x: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    both = f"PARTITION BY {by + ', ' if by else ''}{x}"
    return f"(rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({both}) - 1) / 2.0)::DOUBLE"


@query(f"""WITH {_drawn('quality, n_chars')}, e AS (SELECT d.b, quality, n_chars FROM d JOIN j ON d.k = j.i), f AS (SELECT b, {_rank('quality', 'b')} AS x, {_rank('n_chars', 'b')} AS y FROM e),
r AS (SELECT b, corr(x, y) AS draw FROM f GROUP BY 1), o AS (SELECT {_rank('quality')} AS x, {_rank('n_chars')} AS y FROM j)
SELECT (SELECT round(corr(x, y), 6) FROM o) AS point, (SELECT count(*) FROM o) AS n, {_TAIL} FROM r""")
def bootstrap_spearman(spark, d):
    return rounded(I.bootstrap_spearman(judged(spark, d), "quality", "n_chars", ["doc_id"], B), "point", "std", "ci_low", "ci_high")


@query(f"""WITH {_drawn('n_chars, quality')}, r AS (SELECT d.b, regr_slope(quality, n_chars / 1000) AS draw FROM d JOIN j ON d.k = j.i GROUP BY 1)
SELECT (SELECT round(regr_slope(quality, n_chars / 1000), 6) FROM j) AS point, (SELECT count(*) FROM j) AS n, {_TAIL} FROM r""")
def bootstrap_slope(spark, d):
    return rounded(I.bootstrap_slope(judged(spark, d).withColumn("k_chars", F.col("n_chars") / 1000), "k_chars", "quality", B), "point", "std", "ci_low", "ci_high")


def _auc(label: str, score_rank: str) -> str:
    return f"(sum({score_rank}) FILTER ({label} = 1) - count(*) FILTER ({label} = 1) * (count(*) FILTER ({label} = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER ({label} = 1) * count(*) FILTER ({label} = 0))"


@query(f"""WITH o AS (SELECT quality, {_rank('n_chars')} AS r FROM ({_JUDGED}))
SELECT round({_auc('quality', 'r')}, 6) AS auroc, count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative FROM o""")
def auroc_rank(spark, d):
    return rounded(I.auroc(judged(spark, d), "quality", "n_chars"), "auroc")


@query(f"""WITH {_drawn('n_chars, quality')}, e AS (SELECT d.b, quality, n_chars FROM d JOIN j ON d.k = j.i), f AS (SELECT b, quality, {_rank('n_chars', 'b')} AS r FROM e), r AS (SELECT b, {_auc('quality', 'r')} AS draw FROM f GROUP BY 1),
o AS (SELECT quality, {_rank('n_chars')} AS r FROM j)
SELECT (SELECT round({_auc('quality', 'r')}, 6) FROM o) AS point, (SELECT count(*) FILTER (quality = 1) FROM o) AS n_positive, (SELECT count(*) FILTER (quality = 0) FROM o) AS n_negative, {_TAIL} FROM r""")
def bootstrap_auroc(spark, d):
    return rounded(I.bootstrap_auroc(judged(spark, d), "quality", "n_chars", B), "point", "std", "ci_low", "ci_high")


def _shuffled(rows: str, order: str, values: str, replicates: int, seed: int = 0) -> str:
    """DuckDB: (b, values, k): each replicate's rows with their place k in a random order."""
    placed = f"SELECT b, i, {values} FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({rows})), unnest(range(0, {replicates})) t(b)"
    return f"(SELECT b, {values}, row_number() OVER (PARTITION BY b ORDER BY key) - 1 AS k FROM {keys_sql(placed, seed)})"


@query(f"""WITH m AS (SELECT b, avg(quality) AS draw FROM {_shuffled(_JUDGED, 'doc_id', 'quality', 50, 1)} WHERE k < 50 GROUP BY 1) SELECT round(avg(draw), 6) AS point, {_TAIL} FROM m""")
def subsample_mean(spark, d):
    found = I.subsample_mean(judged(spark, d), "quality", ["doc_id"], 50, 50, 1)
    return rounded(found.drop("n", "n_sub"), "point", "std", "ci_low", "ci_high")


@query(f"""WITH k AS (SELECT quality, ntile(20) OVER (ORDER BY md5('0|' || doc_id), doc_id) AS block FROM ({_JUDGED})), s AS (SELECT block, sum(quality) AS s, count(*) AS c FROM k GROUP BY 1),
v AS (SELECT ((SELECT sum(s) FROM s) - s) / ((SELECT sum(c) FROM s) - c) AS v FROM s), o AS (SELECT avg(quality) AS point FROM k), e AS (SELECT sqrt((count(*) - 1) / count(*) * var_pop(v) * count(*)) AS std, count(*) AS n FROM v)
SELECT round(point, 6) AS point, round(std, 6) AS std, n AS n_blocks, round(point - 1.96 * std, 6)::DOUBLE AS ci_low, round(point + 1.96 * std, 6)::DOUBLE AS ci_high FROM o, e""")
def jackknife_blocks(spark, d):
    return rounded(I.block_jackknife(judged(spark, d), "quality", "doc_id"), "point", "std", "ci_low", "ci_high")


@query(f"""WITH p AS {_PAIRS}, u AS (SELECT a AS unit FROM p UNION SELECT b FROM p), l AS (SELECT unit, avg(v) AS v, count(*) AS c FROM p JOIN u ON a <> unit AND b <> unit GROUP BY 1 HAVING count(*) >= 4),
e AS (SELECT sqrt((count(*) - 1) / count(*) * var_pop(v) * count(*)) AS std, count(*) AS n_units FROM l), o AS (SELECT avg(v) AS point, count(*) AS n FROM p)
SELECT round(point, 4) AS point, n, round(std, 4) AS std, n_units, round(point - 1.96 * std, 4)::DOUBLE AS ci_low, round(point + 1.96 * std, 4)::DOUBLE AS ci_high FROM o, e""")
def jackknife_units(spark, d):
    return rounded(I.jackknife_units(nation_pairs(spark, d), "a", "b", F.avg("v")), "point", "std", "ci_low", "ci_high", digits=4)


def all_events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value", "user_id")


_FIRST = "SELECT event_id, value, event_type = 'click' AS f FROM events"


@query(f"""WITH o AS (SELECT avg(value) FILTER (f) - avg(value) FILTER (NOT f) AS difference, count(*) FILTER (f) AS n_a, count(*) FILTER (NOT f) AS n_b FROM ({_FIRST})),
r AS (SELECT b, avg(value) FILTER (k < n_a) - avg(value) FILTER (k >= n_a) AS draw FROM {_shuffled(_FIRST, 'event_id', 'value', P)}, o GROUP BY b)
SELECT round(difference, 6) AS difference, n_a, n_b, CASE WHEN n_a >= 2 AND n_b >= 2 THEN (SELECT (count(*) FILTER (abs(draw) >= abs(difference) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) END AS p_value FROM o""")
def permutation_2(spark, d):
    return rounded(I.permutation_two(all_events(spark, d), "value", "event_type", "click", ["event_id"], P), "difference")


@query(f"""WITH e AS (SELECT event_id, value / 100 AS value, event_type = 'view' AS f FROM events), o AS (SELECT avg(value) FILTER (f) AS a, avg(value) FILTER (NOT f) AS b, count(*) FILTER (f) AS n_a, count(*) FILTER (NOT f) AS n_b FROM e),
r AS (SELECT m.b AS rep, avg(value) FILTER (k < n_a) - avg(value) FILTER (k >= n_a) AS draw FROM {_shuffled("SELECT event_id, value / 100 AS value FROM events", 'event_id', 'value', P, 7)} m, o GROUP BY m.b)
SELECT 'percentage_points' AS gain_unit, round((a - b) * 100, 1) AS gain_mean, round(a - b, 6) AS gain_mean_raw, round(a * 100, 1) AS gain_group_a_mean, round(b * 100, 1) AS gain_group_b_mean, n_a, n_b,
(SELECT (count(*) FILTER (abs(draw) >= abs(a - b) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) AS p_raw, NULL::DOUBLE AS p_fdr, 'views against the rest' AS tested FROM o""")
def permutation_2_whole(spark, d):
    """The report of a two-group test over all events."""
    rows = all_events(spark, d).withColumn("value", F.col("value") / 100)
    return rounded(I.two_group_report(rows, "value", "event_type", "view", ["event_id"], "gain", tested="views against the rest", replicates=P, seed=7), "gain_mean_raw")


def _f(by: str, source: str) -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"(SELECT {lead}((sum(c * m * m) - sum(c) * (sum(c * m) / sum(c)) ** 2) / (count(*) - 1)) / (sum(c * v) / (sum(c) - count(*))) AS f, count(*) AS g, sum(c) AS n FROM (SELECT {lead}event_type, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM {source} GROUP BY {lead}event_type) {group})"


def _f_test(rows: str, seed: int) -> str:
    return f"""e AS (SELECT *, row_number() OVER (ORDER BY event_type, event_id) - 1 AS i FROM ({rows})), x AS (SELECT m.b, m.value, e.event_type FROM {_shuffled(rows, 'event_type, event_id', 'value', P, seed)} m JOIN e ON m.k = e.i),
o AS {_f('', 'e')}, r AS {_f('b', 'x')}"""


@query(f"""WITH {_f_test('SELECT event_type, event_id, value FROM events', 0)}
SELECT round(f, 6) AS f, g AS n_groups, n::BIGINT AS n, (SELECT (count(*) FILTER (r.f >= o.f * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) AS p_value FROM o""")
def permutation_k(spark, d):
    return rounded(I.permutation_groups(all_events(spark, d), "value", "event_type", ["event_id"], P), "f")


_EIGHTHS = "SELECT user_id % 8 AS event_type, event_id, value FROM events"


@query(f"""WITH {_f_test(_EIGHTHS, 3)}
SELECT g AS k_groups, (SELECT string_agg(m, ';' ORDER BY event_type) FROM (SELECT event_type, round(avg(value) * 100, 1)::VARCHAR AS m FROM ({_EIGHTHS}) GROUP BY 1)) AS group_means_pct,
(SELECT (count(*) FILTER (r.f >= o.f * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) AS p_raw, NULL::DOUBLE AS p_fdr FROM o""")
def permutation_k_whole(spark, d):
    """The report of a test of eight groups of users over all events."""
    rows = all_events(spark, d).withColumn("part", F.col("user_id") % 8)
    return I.groups_report(rows, "value", "part", ["event_id"], P, 3)


def _share(rows: str, seed: int) -> str:
    return f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY reader, event_id) - 1 AS i FROM ({rows})), x AS (SELECT m.b, m.value, e.reader FROM {_shuffled(rows, 'reader, event_id', 'value', P, seed)} m JOIN e ON m.k = e.i),
s AS (SELECT b, reader, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM x GROUP BY ALL), r AS (SELECT b, (sum(c * m * m) - sum(c * m) ** 2 / sum(c)) / (sum(c * m * m) - sum(c * m) ** 2 / sum(c) + sum(c * v)) AS draw FROM s GROUP BY 1),
s0 AS (SELECT reader, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM e GROUP BY 1), o AS (SELECT (sum(c * m * m) - sum(c * m) ** 2 / sum(c)) / (sum(c * m * m) - sum(c * m) ** 2 / sum(c) + sum(c * v)) AS share, sum(c)::BIGINT AS n, count(*) AS n_groups FROM s0)
SELECT round(share, 6) AS share, n, n_groups, round((SELECT avg(draw) FROM r), 6) AS reference_mean, (SELECT (count(*) FILTER (draw >= share * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM r) AS p_raw, round(share - (SELECT avg(draw) FROM r), 6) AS excess FROM o"""


@query(_share("SELECT user_id % 8 AS reader, event_id, value FROM events", 0))
def reader_variance_share(spark, d):
    return _readers(all_events(spark, d).withColumn("reader", F.col("user_id") % 8), 0)


@query(_share("SELECT user_id % 40 AS reader, event_id, value FROM events", 5))
def reader_variance_share_whole(spark, d):
    """Forty readers over all events."""
    return _readers(all_events(spark, d).withColumn("reader", F.col("user_id") % 40), 5)


def _readers(rows, seed):
    return rounded(I.variance_share_reference(rows, "value", "reader", ["event_id"], P, seed, 200, 5), "share", "reference_mean", "excess")


_P = "(SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN least(1.0, abs(value) / 1000)::DOUBLE END AS p_raw FROM events)"


def p_values(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.least(F.lit(1.0), F.abs("value") / 1000)).alias("p_raw"))


@query(f"""WITH q AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN p_raw * count(*) OVER (PARTITION BY event_type, p_raw IS NOT NULL) / row_number() OVER (PARTITION BY event_type, p_raw IS NOT NULL ORDER BY p_raw, event_id) END AS q FROM {_P}),
f AS (SELECT event_id, event_type, p_raw, CASE WHEN p_raw IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY event_type, p_raw IS NOT NULL ORDER BY p_raw, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE END AS p_fdr FROM q)
SELECT event_id, event_type, round(p_raw, 12) AS p_raw, round(p_fdr, 12) AS p_fdr, coalesce(p_fdr < 0.05, false) AS significant_fdr05 FROM f""")
def bh_fdr_family(spark, d):
    return rounded(I.benjamini_hochberg(p_values(spark, d), "p_raw", ["event_type"]), "p_raw", "p_fdr", digits=12)


@query(f"""WITH e AS (SELECT * FROM {_P}), q AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN p_raw * count(*) OVER (PARTITION BY p_raw IS NOT NULL) / row_number() OVER (PARTITION BY p_raw IS NOT NULL ORDER BY p_raw, event_id) END AS q FROM e),
f AS (SELECT event_id, event_type, p_raw, CASE WHEN p_raw IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY p_raw IS NOT NULL ORDER BY p_raw, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE END AS p_fdr FROM q)
SELECT event_id, event_type, round(p_raw, 12) AS p_raw, round(p_fdr, 12) AS p_fdr, coalesce(p_fdr < 0.05, false) AS significant_fdr05 FROM f""")
def bh_fdr(spark, d):
    return rounded(I.benjamini_hochberg(p_values(spark, d), "p_raw"), "p_raw", "p_fdr", digits=12)


_LINE_P = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, CASE WHEN l_tax > 0 THEN (l_discount / 10 + l_quantity / 100) END::DOUBLE AS p_raw FROM lineitem)"


@query(f"""WITH k AS (SELECT l_returnflag, p_raw, count(*) AS c FROM {_LINE_P} WHERE p_raw IS NOT NULL GROUP BY ALL), q AS (SELECT *, p_raw * sum(c) OVER (PARTITION BY l_returnflag) / sum(c) OVER (PARTITION BY l_returnflag ORDER BY p_raw) AS q FROM k),
f AS (SELECT *, least(1.0, min(q) OVER (PARTITION BY l_returnflag ORDER BY p_raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS p_fdr FROM q)
SELECT l_returnflag, round(p_raw, 12) AS p_raw, round(p_fdr, 9) AS p_fdr, p_fdr < 0.05 AS significant_fdr05, c::BIGINT AS n FROM f""")
def bh_fdr_whole(spark, d):
    """Families of p-values that many lines share, by what becomes of a line."""
    lines = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_tax") > 0, F.col("l_discount") / 10 + F.col("l_quantity") / 100).alias("p_raw"))
    found = I.benjamini_hochberg(lines, "p_raw", ["l_returnflag"]).filter("p_raw IS NOT NULL")
    return rounded(rounded(found.groupBy("l_returnflag", "p_raw", "p_fdr", "significant_fdr05").agg(F.count("*").alias("n")), "p_raw", digits=12), "p_fdr", digits=9)


@query("""SELECT event_type, (count(*) FILTER (value >= 50) + 1) / (count(value) + 1.0)::DOUBLE AS p FROM events GROUP BY 1""")
def exceedance_p(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(I.exceedance(e, "value", F.lit(50)).alias("p"))


@query(f"""SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM (SELECT {_rank('l_quantity')} AS x, {_rank('l_extendedprice')} AS y FROM lineitem)""")
def spearman(spark, d):
    return rounded(I.spearman(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), "spearman")


@query(f"""SELECT event_type, round(corr(x, y), 6) AS spearman, count(*) AS n FROM (SELECT event_type, {_rank('value', 'event_type')} AS x, {_rank('user_id', 'event_type')} AS y FROM events) GROUP BY 1""")
def spearman_by_group(spark, d):
    return rounded(I.spearman(table(spark, d, "events").select("event_type", "value", "user_id"), "value", "user_id", ["event_type"]), "spearman")


@query(f"""WITH l AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, o_orderkey::DOUBLE AS z FROM orders), c AS (SELECT regr_slope(x, z) AS sx, regr_intercept(x, z) AS ix, regr_slope(y, z) AS sy, regr_intercept(y, z) AS iy FROM l),
e AS (SELECT round(x - (ix + sx * z), 4) AS ex, round(y - (iy + sy * z), 4) AS ey FROM l, c), r AS (SELECT {_rank('ex')} AS rx, {_rank('ey')} AS ry FROM e)
SELECT CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 5) END AS partial_spearman, count(*) AS n FROM r""")
def partial_spearman(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderkey").cast("double").alias("z"))
    return rounded(I.partial_spearman(rows, "x", "y", "z"), "partial_spearman", digits=5)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, count(*) AS n FROM lineitem GROUP BY 1""")
def slope_r2(spark, d):
    out = I.slope(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(rounded(out, "slope", digits=4), "intercept", digits=3), "r_squared")


@query(f"""WITH k AS (SELECT avg((quality = (n_chars > 1000)::INT)::INT) AS po, avg(quality) AS a, avg((n_chars > 1000)::INT) AS b, count(*) AS n FROM ({_JUDGED})), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM k)
SELECT CASE WHEN pe <> 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa, round(po, 6) AS agreement, n FROM e""")
def cohens_kappa(spark, d):
    rows = judged(spark, d).withColumn("second", (F.col("n_chars") > 1000).cast("int"))
    return rounded(I.kappa(rows, "quality", "second"), "kappa", "agreement")


_DIST = """p AS (SELECT a.n_name AS a, b.n_name AS b, abs(a.m - b.m) AS x, abs(a.s - b.s) AS y FROM z a JOIN z b ON a.n_name < b.n_name)"""
_NATIONS = """z AS (SELECT n_name, avg(c_acctbal) AS m, count(*)::DOUBLE AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


def nation_distances(spark, d):
    z = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("c_acctbal").alias("m"), F.count("*").cast("double").alias("s"))
    one, two = z.select(F.col("n_name").alias("a"), F.col("m").alias("ma"), F.col("s").alias("sa")), z.select(F.col("n_name").alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    return one.join(two, F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("ma") - F.col("mb")).alias("x"), F.abs(F.col("sa") - F.col("sb")).alias("y")), z.select("n_name")


@query(f"""WITH {_NATIONS}, {_DIST}, u AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM z), t AS (SELECT b AS rep, n_name AS dest, k FROM {_shuffled('FROM z', 'n_name', 'n_name', 1000)}),
g AS (SELECT rep, u.n_name AS src, dest FROM t JOIN u ON t.k = u.i), w AS (SELECT ga.rep, p.x, q.y FROM p JOIN g ga ON ga.src = p.a JOIN g gb ON gb.src = p.b AND gb.rep = ga.rep JOIN p q ON q.a = least(ga.dest, gb.dest) AND q.b = greatest(ga.dest, gb.dest)),
r AS (SELECT rep, {_rank('x', 'rep')} AS x, {_rank('y', 'rep')} AS y FROM w), c AS (SELECT rep, corr(x, y) AS draw FROM r GROUP BY 1), o0 AS (SELECT {_rank('x')} AS x, {_rank('y')} AS y FROM p), o AS (SELECT corr(x, y) AS s, count(*) AS n FROM o0)
SELECT round(s, 6) AS spearman, n, (SELECT (count(*) FILTER (abs(draw) >= abs(s) * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE FROM c) AS p_value FROM o""")
def mantel_objects(spark, d):
    pairs, objects = nation_distances(spark, d)
    return rounded(I.mantel(pairs, "a", "b", "x", "y", objects, 1000), "spearman")


_RANGE = """WITH e AS ({rows}), k AS (SELECT user_id FROM e GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM e)), w AS (SELECT * FROM e WHERE user_id IN (SELECT user_id FROM k)),
m AS (SELECT event_type, avg(v) AS m FROM w GROUP BY 1), o AS (SELECT max(m) - min(m) AS r, count(*) AS g FROM m),
s AS (SELECT b, v, row_number() OVER (PARTITION BY b, user_id ORDER BY md5('0|' || b || '|' || user_id || '|' || event_type), event_type) AS g FROM w, unnest(range(0, {n})) q(b)), n AS (SELECT b, g, avg(v) AS m FROM s GROUP BY ALL), c AS (SELECT b, max(m) - min(m) AS draw FROM n GROUP BY 1)
SELECT round(r, 6) AS observed_range, g AS n_groups, round(avg(draw), 6) AS reference_mean, round(quantile_cont(draw, 0.025), 6) AS reference_ci_low, round(quantile_cont(draw, 0.975), 6) AS reference_ci_high, (count(*) FILTER (draw >= r * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE AS p_reference, round(r - avg(draw), 6) AS excess FROM o, c GROUP BY r, g"""


@query(_RANGE.format(rows="SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL", n=50))
def subgroup_range(spark, d):
    return _range(table(spark, d, "events"), 50)


@query(_RANGE.format(rows="SELECT user_id // 3 AS user_id, event_type, max(value) AS v FROM events GROUP BY ALL", n=100))
def subgroup_range_whole(spark, d):
    """Of the largest values of three users each, with a hundred replicates."""
    e = table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 3).alias("user_id"), "event_type").agg(F.max("value").alias("value"))
    return _range(e, 100)


def _range(events, replicates):
    from concord.operators.relational import in_all

    e = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    full = e.join(in_all(e, "user_id", "event_type"), "user_id", "left_semi")
    return rounded(I.range_reference(full, "user_id", "event_type", "v", replicates), "observed_range", "reference_mean", "reference_ci_low", "reference_ci_high", "excess")
