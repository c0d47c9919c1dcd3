"""Queries of probes and their transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import agreement as A
from concord.operators import probes as P
from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.operators.inference import auroc, benjamini_hochberg
from concord.plans.catalogue import query, table
from concord.plans.geometry import views
from concord.plans.statistics import rounded


def labelled(spark, d, *names):
    """Views with the finding `y` (label below 5) and `part`, split by case."""
    v = views(spark, d, *names).withColumn("y", (F.col("label") < 5).cast("int"))
    return S.unit_split(v, "case_id", 42)


@query()
def linear_probe(spark, d):
    rows = labelled(spark, d, "full")
    probe = P.fit_probe(rows.filter("part = 'train'"), "y")
    return rounded(auroc(probe.score(rows.filter("part = 'test'")), "y", "score"), "auroc", digits=4)


@query()
def finding_aurocs(spark, d):
    rows = labelled(spark, d, "full").withColumns({f"f{k}": (F.col("label") == k).cast("int") for k in range(3)})
    return rounded(P.finding_aurocs(rows.filter("part = 'train'"), rows.filter("part = 'test'"), ["f0", "f1", "f2"]), "auroc", digits=4)


@query()
def multiclass_probe(spark, d):
    rows = labelled(spark, d, "full").withColumn("k", F.col("label") % 3)
    found = P.multiclass_accuracy(rows.filter("part = 'train'"), rows.filter("part = 'test'"), "k")
    return rounded(found, "accuracy", "majority", digits=4)


@query()
def refit_budget(spark, d):
    """Twenty probes on a hundred labelled cases each."""
    rows = labelled(spark, d, "full")
    found = P.budget_refits(rows.filter("part = 'train'"), rows.filter("part = 'test'"), "y", 100)
    return rounded(found, "auroc", digits=4)


@query()
def transfer_matrix(spark, d):
    names = ["va", "vb"]
    rows = labelled(spark, d, *names)
    anchors = S.capped(table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id")), 32, 1, "case_id").withColumn("pos", F.col("case_id"))
    rel = V.relative(rows, anchors).join(rows.drop("embedding"), ["encoder", "case_id"])
    out = P.transfer_matrix(rel.filter("part = 'train'"), rel.filter("part = 'test'"), "y", names, "relative")
    return rounded(out, "auroc", "oracle_auroc", "retention", "chance_corrected", digits=4)


@query()
def stitch_retention(spark, d):
    """A probe of one view on the other's vectors, sent through an affine map."""
    rows = labelled(spark, d, "va", "vb")
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    matrix = A.affine_map(V.grams(train.select("encoder", "case_id", "embedding")), "va", "vb")
    target = P.fit_probe(train.filter("encoder = 'vb'"), "y")
    best = auroc(target.score(test.filter("encoder = 'vb'")), "y", "score").select(F.col("auroc").alias("oracle_auroc"))
    out = None
    for method, moved in (("affine", P.mapped(test.filter("encoder = 'va'"), matrix)), ("identity", test.filter("encoder = 'va'"))):
        one = auroc(target.score(moved), "y", "score").select(F.lit("va").alias("enc_src"), F.lit("vb").alias("enc_tgt"), F.lit(method).alias("method"), "auroc")
        out = one if out is None else out.unionByName(one)
    return rounded(out.crossJoin(best).withColumn("retention", F.col("auroc") / F.col("oracle_auroc")), "auroc", "oracle_auroc", "retention", digits=4)  # one row


@query("""WITH a AS (SELECT least(c_nationkey, s) AS lo, greatest(c_nationkey, s) AS hi, avg(c_acctbal) AS alignment FROM (SELECT c_nationkey, (c_nationkey * 7 + c_custkey) % 25 AS s, c_acctbal FROM customer) GROUP BY ALL),
r AS (SELECT least(s_nationkey, t) AS lo, greatest(s_nationkey, t) AS hi, avg(s_acctbal) AS retention FROM (SELECT s_nationkey, (s_nationkey * 7 + s_suppkey) % 25 AS t, s_acctbal FROM supplier) GROUP BY ALL),
f AS (SELECT lo % 5 AS family, regr_slope(retention, alignment) AS slope, regr_r2(retention, alignment) AS r2, count(*) AS n FROM a JOIN r USING (lo, hi) GROUP BY 1),
p AS (SELECT *, 1 - coalesce(r2, 0) AS p_raw FROM f), q AS (SELECT *, p_raw * count(*) OVER () / row_number() OVER (ORDER BY p_raw, family) AS q FROM p)
SELECT family::INT AS family, round(slope, 6) AS slope, n, round(p_raw, 6) AS p_raw, round(least(1.0, min(q) OVER (ORDER BY p_raw, family ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS p_fdr FROM q""")
def link_slopes(spark, d):
    """Two pair tables joined on the unordered pair, a slope for each family, and false-discovery control."""
    from concord.operators.relational import pair_means

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).alias("b"), "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).alias("b"), "s_acctbal")
    x = pair_means(c, "a", "b", "c_acctbal").select("pair_lo", "pair_hi", F.col("mean_value").alias("alignment"))
    y = pair_means(s, "a", "b", "s_acctbal").select("pair_lo", "pair_hi", F.col("mean_value").alias("retention"))
    per = x.join(y, ["pair_lo", "pair_hi"]).groupBy((F.col("pair_lo") % 5).cast("int").alias("family")).agg(F.regr_slope("retention", "alignment").alias("slope"), F.regr_r2("retention", "alignment").alias("r2"), F.count("*").alias("n"))
    out = benjamini_hochberg(per.withColumn("p_raw", 1 - F.coalesce("r2", F.lit(0.0))), "p_raw")
    return rounded(out.select("family", "slope", "n", "p_raw", "p_fdr"), "slope", "p_raw", "p_fdr")


@query()
def cross_site(spark, d):
    """A probe fitted at one site, by parity of the case, and tested at the other."""
    rows = labelled(spark, d, "full").withColumn("site", (F.col("case_id") % 2).cast("int"))
    probe = P.fit_probe(rows.filter("site = 0"), "y")
    return rounded(auroc(probe.score(rows.filter("site = 1")), "y", "score", ["site"]), "auroc", digits=4)
