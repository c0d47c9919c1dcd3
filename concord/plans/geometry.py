"""Queries of vector algebra on overlapping and disjoint views of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import agreement as A
from concord.operators import sampling as S
from concord.operators import vectors as V
from concord.operators.inference import spearman, subsample_mean
from concord.plans import pipelines as C
from concord.plans.catalogue import query, table
from concord.plans.statistics import _shuffled, rounded

#: The fixture's encoders: first dimension and number of dimensions of each view.
VIEWS = {"full": (1, 64), "va": (1, 48), "vb": (17, 48), "floor_a": (1, 32), "floor_b": (33, 32)}
K = 10


def views(spark, d, *names):
    """(encoder, case_id, embedding, label) with the normalised slice of each view."""
    e = table(spark, d, "embeddings")
    out = None
    for n in names:
        one = e.select(F.lit(n).alias("encoder"), F.col("vec_id").alias("case_id"), V.sliced(F.col("embedding"), *VIEWS[n]).alias("embedding"), "label")
        out = one if out is None else out.unionByName(one)
    return out


def _view(name: str) -> str:
    first, n = VIEWS[name]
    return f"SELECT '{name}' AS e, vec_id AS id, list_transform(embedding[{first}:{first + n - 1}], lambda x: x::DOUBLE / sqrt(list_inner_product(embedding[{first}:{first + n - 1}]::DOUBLE[], embedding[{first}:{first + n - 1}]::DOUBLE[]))) AS v FROM embeddings"


def _edges(*names: str, k: int = K) -> str:
    return f"""x AS ({' UNION ALL '.join(_view(n) for n in names)}),
edge AS (SELECT * FROM (SELECT a.e, a.id AS src, b.id AS dst, list_inner_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.e, a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r FROM x a JOIN x b ON a.e = b.e AND a.id <> b.id) WHERE r <= {k})"""


@query(f"""WITH {_edges('full')} SELECT e AS encoder, src, dst, round(s, 9) AS similarity, r::INT AS rank FROM edge""")
def knn_graph(spark, d):
    return rounded(V.knn_edges(views(spark, d, "full"), K), "similarity", digits=9)


def _overlap(a: str, b: str, k: int = K) -> str:
    return f"""{_edges(a, b, k=k)}, o AS (SELECT x.src, count(y.dst) / {float(k)} AS overlap FROM edge x LEFT JOIN edge y ON y.e = '{b}' AND x.src = y.src AND x.dst = y.dst WHERE x.e = '{a}' GROUP BY 1)"""


def _mknn(a: str, b: str, k: int = K) -> str:
    return f"WITH {_overlap(a, b, k)} SELECT '{a}' AS encoder_a, '{b}' AS encoder_b, round(avg(overlap), 6)::DOUBLE AS mknn, count(*) AS n FROM o"


@query(_mknn("va", "vb"))
def mknn_views(spark, d):
    return rounded(A.mutual_knn(V.neighbour_lists(V.knn_edges(views(spark, d, "va", "vb"), K)), K), "mknn")


@query(_mknn("floor_a", "floor_b"))
def mknn_floor(spark, d):
    return rounded(A.mutual_knn(V.neighbour_lists(V.knn_edges(views(spark, d, "floor_a", "floor_b"), K)), K), "mknn")


@query(f"WITH {_overlap('va', 'vb')} SELECT 'va' AS encoder_a, 'vb' AS encoder_b, src AS case_id, overlap::DOUBLE AS overlap FROM o")
def row_overlap(spark, d):
    return A.row_overlap(V.neighbour_lists(V.knn_edges(views(spark, d, "va", "vb"), K)), K)


@query(f"""WITH {_edges('full', 'va', 'vb')}, c AS (SELECT src, dst, count(*) AS n FROM edge GROUP BY ALL), j AS (SELECT src, count(*) FILTER (n = 3) / count(*) AS jac FROM c GROUP BY 1),
o AS (SELECT x.src, count(y.dst) / 3.0 / {K} AS m FROM edge x LEFT JOIN edge y ON x.src = y.src AND x.dst = y.dst AND x.e < y.e GROUP BY 1)
SELECT src AS case_id, round(m, 6)::DOUBLE AS mean_overlap, round(jac, 6)::DOUBLE AS all_jaccard, round(1 - jac, 6)::DOUBLE AS deviation FROM j JOIN o USING (src)""")
def case_agreement(spark, d):
    lists = V.neighbour_lists(V.knn_edges(views(spark, d, "full", "va", "vb"), K))
    return rounded(A.case_agreement(lists, K), "mean_overlap", "all_jaccard", "deviation")


@query(f"""WITH {_overlap('va', 'vb')}, m AS (SELECT b, avg(overlap) AS draw FROM {_shuffled('FROM o', 'src', 'overlap', 1000)} WHERE k < 200 GROUP BY 1)
SELECT round(avg(draw), 6)::DOUBLE AS point, round(stddev_samp(draw), 6) AS std, round(quantile_cont(draw, 0.025), 6)::DOUBLE AS ci_low, round(quantile_cont(draw, 0.975), 6)::DOUBLE AS ci_high, count(draw) AS n_draws FROM m""")
def subsample_mknn(spark, d):
    rows = A.row_overlap(V.neighbour_lists(V.knn_edges(views(spark, d, "va", "vb"), K)), K).select("case_id", "overlap")
    return rounded(subsample_mean(rows, "overlap", ["case_id"], 200, 1000, 0).drop("n", "n_sub"), "point", "std", "ci_low", "ci_high")


def _hsic(a: str, b: str) -> str:
    return f"""(SELECT ((SELECT coalesce(sum(p.w * q.w), 0) FROM {a} p JOIN {b} q ON p.src = q.dst AND p.dst = q.src) + (SELECT sum(w) FROM {a}) * (SELECT sum(w) FROM {b}) / ((n - 1) * (n - 2))
 - 2 * (SELECT coalesce(sum(c * r), 0) FROM (SELECT dst AS i, sum(w) AS c FROM {a} GROUP BY 1) JOIN (SELECT src AS i, sum(w) AS r FROM {b} GROUP BY 1) USING (i)) / (n - 2)) / (n * (n - 3)) FROM (SELECT count(*)::DOUBLE AS n FROM embeddings))"""


def _weighted(k: int) -> str:
    return f"""WITH {_edges('va', 'vb', k=k)}, a AS (SELECT src, dst, s AS w FROM edge WHERE e = 'va'), b AS (SELECT src, dst, s AS w FROM edge WHERE e = 'vb'), ab AS (SELECT a.* FROM a SEMI JOIN b USING (src, dst)), ba AS (SELECT b.* FROM b SEMI JOIN a USING (src, dst))
SELECT round({_hsic('ab', 'ba')} / sqrt({_hsic('a', 'a')} * {_hsic('b', 'b')}), 6) AS cknna"""


@query(_weighted(K))
def cknna_weighted(spark, d):
    from concord.sources.shared import cut

    v = views(spark, d, "va", "vb")
    n = table(spark, d, "embeddings").count()
    value = A.cknna(cut(V.knn_edges(v, K)), "va", "vb", n, K)
    return spark.createDataFrame([(round(value, 6),)], "cknna double")


def _trace(a: str, b: str) -> str:
    dot = lambda x, y: f"(SELECT coalesce(sum(c * r), 0) FROM (SELECT dst AS i, count(*) AS c FROM {x} GROUP BY 1) JOIN (SELECT src AS i, count(*) AS r FROM {y} GROUP BY 1) USING (i))"
    return f"(SELECT (SELECT count(*) FROM {a} p JOIN {b} q ON p.src = q.dst AND p.dst = q.src) - {dot(a, b)} / n - {dot(b, a)} / n + (SELECT count(*) FROM {a}) * (SELECT count(*) FROM {b}) / (n * n) FROM (SELECT count(*)::DOUBLE AS n FROM embeddings))"


def _binary(k: int) -> str:
    return f"""WITH {_edges('va', 'vb', k=k)}, a AS (SELECT src, dst FROM edge WHERE e = 'va'), b AS (SELECT src, dst FROM edge WHERE e = 'vb')
SELECT round({_trace('a', 'b')} / sqrt({_trace('a', 'a')} * {_trace('b', 'b')}), 6) AS cknna_binary"""


@query(_binary(K))
def cknna_binary(spark, d):
    from concord.sources.shared import cut

    n = table(spark, d, "embeddings").count()
    value = A.cknna_binary(cut(V.knn_edges(views(spark, d, "va", "vb"), K)), "va", "vb", n, K)
    return spark.createDataFrame([(round(value, 6),)], "cknna_binary double")


def _flat(name: str) -> str:
    return f"SELECT id, i, v[i]::DOUBLE AS x FROM ({_view(name)}), unnest(range(1, {VIEWS[name][1] + 1})) t(i)"


def _cov(a: str, b: str) -> str:
    return f"(SELECT sum(c * c) FROM (SELECT p.i, q.i AS j, sum(p.x * q.x) - sum(p.x) * sum(q.x) / count(*) AS c FROM {a} p JOIN {b} q USING (id) GROUP BY ALL))"


_LINEAR = f"""WITH a AS ({_flat('va')}), b AS ({_flat('vb')}) SELECT round({_cov('a', 'b')} / sqrt({_cov('a', 'a')} * {_cov('b', 'b')}), 6) AS cka"""


@query(_LINEAR)
def cka_linear(spark, d):
    return spark.createDataFrame([(round(A.linear_cka(V.grams(views(spark, d, "va", "vb")), "va", "vb"), 6),)], "cka double")


@query()
def procrustes(spark, d):
    return spark.createDataFrame([(round(A.procrustes(V.grams(views(spark, d, "va", "vb")), "va", "vb"), 6),)], "procrustes double")


@query()
def gpa_consensus(spark, d):
    names = ["full", "va", "vb"]
    residual, history, done = A.generalised_procrustes(V.grams(views(spark, d, *names)), names)
    return spark.createDataFrame([(e, round(residual[e], 6), len(history), done) for e in names], "encoder string, residual double, iterations int, converged boolean")


_RANKED = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)::DOUBLE"


def _rsa_sql(one: str, other: str) -> str:
    return f"""WITH s AS (SELECT vec_id FROM embeddings ORDER BY md5('0|' || vec_id), vec_id LIMIT 2000), a AS ({_view(one)}), b AS ({_view(other)}),
p AS (SELECT round(list_inner_product(x.v, y.v), 9) AS sa, round(list_inner_product(z.v, w.v), 9) AS sb FROM a x JOIN a y ON x.id < y.id JOIN b z ON z.id = x.id JOIN b w ON w.id = y.id WHERE x.id IN (SELECT vec_id FROM s) AND y.id IN (SELECT vec_id FROM s)),
r AS (SELECT {_RANKED.format('sa')} AS x, {_RANKED.format('sb')} AS y FROM p) SELECT round(corr(x, y), 5) AS spearman, count(*) AS n FROM r"""


@query(_rsa_sql("full", "floor_b"))
def rsa_spearman_whole(spark, d):
    """Of the whole vectors and their second halves."""
    return _rsa(spark, d, 2000, "full", "floor_b")


@query(_rsa_sql("va", "vb"))
def rsa_spearman(spark, d):
    return _rsa(spark, d, 2000)


def _rsa(spark, d, n, one="va", other="vb"):
    chosen = S.capped(table(spark, d, "embeddings").select("vec_id"), n, 0, "vec_id")
    v = views(spark, d, one, other).join(chosen, F.col("case_id") == F.col("vec_id"), "left_semi")
    pairs = rounded(A.similarity_pairs(v, one, other), "s_a", "s_b", digits=9)
    return rounded(spearman(pairs, "s_a", "s_b"), "spearman", digits=5)


_RBF = f"""WITH s AS (SELECT vec_id FROM embeddings ORDER BY md5('0|' || vec_id), vec_id LIMIT 2000), a AS ({_view('va')}), b AS ({_view('vb')}), x AS (SELECT a.id, a.v AS va, b.v AS vb FROM a JOIN b USING (id) JOIN s ON a.id = s.vec_id),
q AS (SELECT x.id AS i, y.id AS j, greatest(list_inner_product(x.va, x.va) + list_inner_product(y.va, y.va) - 2 * list_inner_product(x.va, y.va), 0) AS da, greatest(list_inner_product(x.vb, x.vb) + list_inner_product(y.vb, y.vb) - 2 * list_inner_product(x.vb, y.vb), 0) AS db FROM x JOIN x y ON x.id <> y.id),
w AS (SELECT median(da) AS w, (SELECT count(*) FROM x)::DOUBLE AS n FROM q WHERE da > 0), k AS (SELECT i, j, exp(-da / (2 * w)) AS k, exp(-db / (2 * w)) AS l, n FROM q, w), r AS (SELECT i, sum(k) AS rk, sum(l) AS rl FROM k GROUP BY 1),
h AS (SELECT sum(k * l) AS kl, sum(k * k) AS kk, sum(l * l) AS ll, sum(k) AS sk, sum(l) AS sl, any_value(n) AS n FROM k), g AS (SELECT sum(rk * rl) AS kl, sum(rk * rk) AS kk, sum(rl * rl) AS ll FROM r)
SELECT round((h.kl - 2 * g.kl / n + sk * sl / (n * n)) / sqrt((h.kk - 2 * g.kk / n + sk * sk / (n * n)) * (h.ll - 2 * g.ll / n + sl * sl / (n * n))), 6) AS cka_rbf FROM h, g"""


@query(_RBF)
def cka_rbf(spark, d):
    return spark.createDataFrame([(round(float(A.rbf_cka(views(spark, d, "va", "vb"), "va", "vb")), 6),)], "cka_rbf double")


@query(f"""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY md5('1|' || vec_id), vec_id) - 1 AS pos FROM embeddings ORDER BY 2 LIMIT 8), x AS ({_view('va')})
SELECT x.id AS case_id, pos::INT AS pos, round(list_inner_product(x.v, a.v), 9) AS similarity FROM x, s JOIN x a ON a.id = s.vec_id""")
def relative_reps(spark, d):
    from pyspark.sql import Window

    chosen = S.capped(table(spark, d, "embeddings").select("vec_id"), 8, 1, "vec_id")
    order = Window.orderBy(S.hash_key(1, F.col("vec_id")), "vec_id")
    anchors = chosen.select(F.col("vec_id").alias("case_id"), (F.row_number().over(order) - 1).alias("pos"))  # eight rows
    rel = V.relative(views(spark, d, "va"), anchors)
    return rel.select("case_id", F.posexplode("relative").alias("pos", "similarity")).withColumn("similarity", F.round("similarity", 9))


_CENTRES = """c0 AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM {0}, unnest(range(1, 65)) t(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS v, greatest(sqrt(sum(m * m)), 1e-9) AS s FROM c0 GROUP BY 1)"""


@query(f"""WITH {_CENTRES.format('embeddings')} SELECT a.label AS a, b.label AS b, round(1 - list_inner_product(a.v, b.v) / (a.s * b.s), 6) AS distance FROM c a JOIN c b ON a.label < b.label""")
def class_centroid_distance(spark, d):
    return rounded(V.centroid_distances(V.centroids(table(spark, d, "embeddings"), "label"), "label").filter("a < b"), "distance")


def _structure(replicates: int) -> str:
    return f"""WITH e AS (SELECT label, row_number() OVER (ORDER BY label, vec_id) - 1 AS i FROM embeddings), p AS (SELECT m.b, e.label, m.embedding FROM {_shuffled('FROM embeddings', 'label, vec_id', 'embedding', replicates)} m JOIN e ON m.k = e.i
UNION ALL SELECT -1, label, embedding FROM embeddings), c0 AS (SELECT b, label, i, avg(embedding[i]::DOUBLE) AS m FROM p, unnest(range(1, 65)) t(i) GROUP BY ALL), c AS (SELECT b, label, list(m ORDER BY i) AS v, greatest(sqrt(sum(m * m)), 1e-9) AS s FROM c0 GROUP BY ALL),
r AS (SELECT x.b, avg(1 - list_inner_product(x.v, y.v) / (x.s * y.s)) AS d FROM c x JOIN c y ON x.b = y.b AND x.label < y.label GROUP BY 1)"""


@query(f"{_structure(10)} SELECT b::INT AS b, round(d, 6) AS mean_distance FROM r WHERE b >= 0")
def structural_reference(spark, d):
    found = A.structural_reference(table(spark, d, "embeddings"), "label", "vec_id", 10)
    return rounded(found.filter("replicate >= 0").withColumnRenamed("replicate", "b"), "mean_distance")


@query(f"""{_structure(200)} SELECT round(any_value(o.d), 6) AS mean_distance, round(avg(r.d), 6) AS reference_mean, round(quantile_cont(r.d, 0.025), 6) AS reference_ci_low, round(quantile_cont(r.d, 0.975), 6) AS reference_ci_high,
round(any_value(o.d) - avg(r.d), 6) AS excess, (count(*) FILTER (r.d >= o.d * (1 - 1e-9)) + 1) / (count(*) + 1.0)::DOUBLE AS p_value FROM r, (SELECT d FROM r WHERE b < 0) o WHERE r.b >= 0""")
def structural_reference_whole(spark, d):
    """The distance of the classes against its reference, with the replicates of the original."""
    found = A.structural_reference(table(spark, d, "embeddings"), "label", "vec_id", 200)
    draws, own = found.filter("replicate >= 0"), F.max(F.when(F.col("replicate") < 0, F.col("mean_distance")))
    return rounded(C.referenced(draws, "mean_distance", found.agg(own).first()[0]), "mean_distance", "reference_mean", "reference_ci_low", "reference_ci_high", "excess")


@query(f"""WITH x AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM ({_view('full')})), n AS (SELECT greatest(1, count(*)) AS n FROM x), t AS (SELECT o_orderkey AS tid, o_orderkey % n AS a, o_custkey % n AS b, (o_orderkey + o_custkey) % n AS c FROM orders, n),
z AS (SELECT tid, 1 - list_inner_product(x.v, y.v) AS db, 1 - list_inner_product(x.v, w.v) AS dc FROM t JOIN x ON x.id = t.a JOIN x y ON y.id = t.b JOIN x w ON w.id = t.c)
SELECT tid, CASE WHEN db < dc THEN 'b' ELSE 'c' END AS nearer FROM z WHERE abs(db - dc) >= 1e-9""")
def triplet_choice(spark, d):
    """All orders, with endpoints among all vectors by their place in the order of ids."""
    return _triplets(spark, d)


_TRIPLETS = """t AS (SELECT o_orderkey % n AS a, o_custkey % n AS b, (o_orderkey + o_custkey) % n AS c, CASE WHEN o_orderkey % 3 = 0 THEN ' B ' ELSE 'c' END AS choice FROM orders, (SELECT greatest(1, count(*)) + 7 AS n FROM embeddings)),
f AS (SELECT vec_id AS id, (1 << label) | (1 << ((vec_id % 4)::INT + 10)) AS bits FROM embeddings WHERE vec_id % 11 <> 0)"""


@query(f"""WITH {_TRIPLETS}, x AS (SELECT e, id, v FROM ({_view('full')}) UNION ALL SELECT e, id, v FROM ({_view('va')}) WHERE id % 10 <> 3 UNION ALL SELECT 'consensus', id, v FROM ({_view('vb')})),
z AS (SELECT p.e, CASE WHEN fa.bits IS NULL OR fb.bits IS NULL OR fc.bits IS NULL THEN 'labels_unavailable' WHEN (fa.bits & fb.bits > 0) <> (fa.bits & fc.bits > 0) THEN 'one_candidate_shares_a_finding' ELSE 'ambiguous_by_labels' END AS s,
  lower(trim(choice)) AS choice, list_inner_product(x.v, y.v) - list_inner_product(x.v, w.v) AS gap FROM t JOIN (VALUES ('full'), ('va'), ('consensus')) p(e) ON true LEFT JOIN x ON x.e = p.e AND x.id = t.a LEFT JOIN x y ON y.e = p.e AND y.id = t.b LEFT JOIN x w ON w.e = p.e AND w.id = t.c
  LEFT JOIN f fa ON fa.id = t.a LEFT JOIN f fb ON fb.id = t.b LEFT JOIN f fc ON fc.id = t.c),
n AS (SELECT e, count(*) FILTER (abs(gap) < 1e-9) AS n_tied, count(*) FILTER (gap IS NULL) AS n_absent_case, count(*) AS n_triplets FROM z GROUP BY 1),
g AS (SELECT e, coalesce(s, 'all') AS conditioning, round(avg((CASE WHEN gap > 0 THEN 'b' ELSE 'c' END = choice)::INT), 6) AS triplet_acc, count(*) AS n_scored FROM z WHERE abs(gap) >= 1e-9 GROUP BY GROUPING SETS ((e), (e, s)))
SELECT e AS encoder, CASE e WHEN 'consensus' THEN 'consensus' ELSE 'frozen_panel' END AS encoder_kind, conditioning, triplet_acc, n_scored, n_tied, n_absent_case, n_triplets FROM g JOIN n USING (e)""")
def triplet_choice_whole(spark, d):
    """Triplets of all orders by encoder and by what the labels say, some of whose cases have no labels, no vector or no row."""
    e = table(spark, d, "embeddings")
    most = max(1, e.count()) + 7
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, d, "orders").select((o % most).alias("a"), (c % most).alias("b"), ((o + c) % most).alias("c"), F.when(o % 3 == 0, " B ").otherwise("c").alias("choice"))
    known = e.filter("vec_id % 11 <> 0").select(F.col("vec_id").alias("case_id"), F.explode(F.array(F.concat(F.lit("f"), "label"), F.concat(F.lit("g"), F.col("vec_id") % 4))).alias("finding"))
    v = views(spark, d, "full", "va", "vb").filter("encoder <> 'va' OR case_id % 10 <> 3").withColumn("encoder", F.when(F.col("encoder") == "vb", "consensus").otherwise(F.col("encoder")))
    found = V.triplet_accuracy(V.triplet_strata(t, known, known), v, {"consensus": "consensus"})
    return rounded(found, "triplet_acc")


def _triplets(spark, d):
    from concord.operators.order import positions

    orders, v = table(spark, d, "orders"), positions(views(spark, d, "full"), ["case_id"], "at")
    n = max(1, v.count())
    t = orders.select(F.col("o_orderkey").alias("tid"), (F.col("o_orderkey") % n).alias("a"), (F.col("o_custkey") % n).alias("b"), ((F.col("o_orderkey") + F.col("o_custkey")) % n).alias("c"))
    return V.triplet_choice(t, v.drop("case_id").withColumnRenamed("at", "case_id")).select("tid", "nearer")


@query(f"""WITH {_CENTRES.format('(SELECT * FROM embeddings WHERE label = 0)')}, r AS (SELECT e.label, round(1 - list_inner_product(e.embedding::DOUBLE[], c.v) / c.s, 9) AS dist FROM embeddings e, c WHERE e.label >= 1),
k AS (SELECT {_RANKED.format('label')} AS x, {_RANKED.format('dist')} AS y FROM r) SELECT round(corr(x, y), 5) AS spearman, count(*) AS n FROM k""")
def centroid_grade_order(spark, d):
    e = table(spark, d, "embeddings")
    far = V.distance_from(e.filter("label >= 1"), V.centroids(e.filter("label = 0"), "label"))
    return rounded(spearman(rounded(far, "distance", digits=9), "label", "distance"), "spearman", digits=5)


@query("""SELECT 'quantity' AS block, round(regr_r2(l_extendedprice, l_quantity), 6) AS alone FROM lineitem UNION ALL SELECT 'discount', round(regr_r2(l_extendedprice, l_discount), 6) FROM lineitem""")
def block_r2(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("x").alias("encoder"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("case_id"), F.array("l_extendedprice", "l_quantity", "l_discount").alias("embedding"))
    found = A.block_r_squared(V.grams(rows)["x", "x"], 0, {"quantity": [1], "discount": [2]})
    return spark.createDataFrame([(k, round(found[k]["alone"], 6)) for k in ("quantity", "discount")], "block string, alone double")


@query("""WITH u AS (SELECT label, i, sum(embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS s, count(*) AS n FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY ALL)
SELECT label, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6)::DOUBLE AS mean_cosine, max(n) AS n FROM u GROUP BY 1""")
def mean_cosine(spark, d):
    return rounded(V.mean_cosine(table(spark, d, "embeddings"), ["label"]), "mean_cosine")


@query("""SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def finite_rows(spark, d):
    return V.finite_rows(table(spark, d, "embeddings")).select("vec_id")
