"""Linear probes on vectors and their transfer between encoders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.numbers import chance_corrected, retention
from concord.operators.agreement import affine_map
from concord.operators import resampling as X
from concord.operators.inference import auroc, spread_of
from concord.operators.order import positions
from concord.operators.sampling import capped, hash_key, unit_split
from concord.operators.vectors import finite_rows, grams
from concord.sources.shared import cut

C = 0.1
ITERATIONS = 150
LEAST_TRAIN, LEAST_TEST = 20, 10


class Probe:
    """A fitted probe: scale of each component, and the model on scaled vectors."""

    def __init__(self, mean: list[float], scale: list[float], model: LogisticRegressionModel):
        self.mean, self.scale, self.model = mean, scale, model

    def _scaled(self, v: Column) -> Column:
        mean, scale = (F.array(*map(F.lit, x)) for x in (self.mean, self.scale))
        centred = F.zip_with(v, mean, lambda x, m: x.cast("double") - m)
        return array_to_vector(F.zip_with(centred, scale, lambda x, s: x / s))

    def score(self, df: DataFrame, embedding: str = "embedding", out: str = "score") -> DataFrame:
        """df with the probability of class 1; of every class in order for more than two."""
        scored = self.model.transform(df.withColumn("_features", self._scaled(F.col(embedding)))).withColumn("_p", vector_to_array("probability"))
        value = F.col("_p")[1] if self.model.numClasses == 2 else F.col("_p")
        return scored.withColumn(out, value).withColumn("predicted", F.col("prediction").cast("int")).drop("_features", "_p", "rawPrediction", "probability", "prediction")


def fit_probe(df: DataFrame, label: str, embedding: str = "embedding", c: float = C, iterations: int = ITERATIONS) -> Probe:
    """Logistic regression with L2 penalty on vectors scaled by their population deviation, classes weighted to balance.

    c is the inverse strength of the penalty over the sum of losses, so Spark's parameter is 1 / (c n).
    """
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(embedding).alias("v"))
    per = rows.groupBy("label").count().collect()
    n, weights = sum(r["count"] for r in per), {r["label"]: 1.0 / (len(per) * r["count"]) for r in per}
    stats = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).orderBy("d").collect()
    mean, scale = [r.m for r in stats], [r.s or 1.0 for r in stats]
    probe = Probe(mean, scale, None)
    weight = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, w * n)))[F.col("label")]
    data = rows.select("label", weight.alias("weight"), probe._scaled(F.col("v")).alias("_features"))
    data = cut(data.select("label", "weight", vector_to_array("_features").alias("x"))).coalesce(max(1, -(-n // CELL_ROWS))).select("label", "weight", array_to_vector("x").alias("_features"))  # few rows in few tasks, as each step is a job
    probe.model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)
    return probe


def usable(df: DataFrame, label: str, least: int) -> bool:
    """Enough labelled rows, of two classes."""
    r = df.filter(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.countDistinct(label).alias("k")).first()
    return r.n >= least and r.k >= 2


#: Rows of a packed cell, and bytes of Hessians that a round of fits holds.
CELL_ROWS = 2048
HESSIANS = 64 << 20
#: A fit is done when Newton's step changes no scaled coefficient by more.
CLOSE = 1e-9


class Probes:
    """Fitted probes by group: a matrix with one column for each response, of the components' coefficients and the intercept."""

    def __init__(self, coefficients: dict[str, np.ndarray]):
        self.coefficients = coefficients

    def scores(self, df: DataFrame, group: Column | None = None, embedding: str = "embedding", out: str = "scores") -> DataFrame:
        """df with the probability of class 1 for each response, in order; those of the probes of `group`, NULL where there are none or no vector."""
        import pyarrow as pa
        from pyspark.sql import types as T

        from concord.operators.vectors import _matrix

        shared = df.sparkSession.sparkContext.broadcast(self.coefficients)
        named = df.withColumn("_group", group.cast("string") if group is not None else F.lit("")).select("*", F.col(embedding).cast("array<double>").alias("_x"))
        schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches):
            for batch in batches:
                names, there = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
                rows = [None] * batch.num_rows
                for name in set(names) & shared.value.keys():
                    own = np.flatnonzero([n == name and t for n, t in zip(names, there)])
                    b = shared.value[name]
                    if len(own):
                        for i, p in zip(own, _sigmoid(_matrix(batch.column(batch.num_columns - 1).take(pa.array(own)), len(b) - 1) @ b[:-1] + b[-1])):
                            rows[i] = p
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

        return named.mapInArrow(run, schema)


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def _packed(df: DataFrame, labels: Sequence[str], embedding: str, group: Column | None) -> tuple[DataFrame, int]:
    """((group, data) of cells of rows: components, then labels, NaN for none; number of components). Rows stay in their tasks."""
    import pyarrow as pa

    y = F.array(*(F.when(F.col(c).isin(0, 1), F.col(c).cast("double")).otherwise(F.lit(float("nan"))) for c in labels))
    rows = df.filter(F.col(embedding).isNotNull()).select((group.cast("string") if group is not None else F.lit("")).alias("group"), F.col(embedding).cast("array<double>").alias("x"), y.alias("y"))
    rows = cut(rows.filter(F.col("group").isNotNull()))
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    full = F.concat("x", F.array_repeat(F.lit(0.0), (F.lit(width or 0) - F.size("x")).cast("int")), "y")

    def pack(batches):
        held: dict[str, list[np.ndarray]] = {}

        def cell(name):
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([np.concatenate(held.pop(name)).tobytes()])], names=["group", "data"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for name in np.unique(names):
                own = batch.column(1).take(pa.array(np.flatnonzero(names == name)))
                for at in range(0, len(own), CELL_ROWS):
                    part = own.slice(at, CELL_ROWS)
                    held.setdefault(str(name), []).append(np.array(part.flatten(), np.float64).reshape(len(part), -1))
                    if sum(map(len, held[str(name)])) >= CELL_ROWS:
                        yield cell(str(name))
        for name in list(held):
            yield cell(name)

    cells = rows.select("group", full.alias("x")).mapInArrow(pack, "group string, data binary")
    return cut(cells.repartition(max(1, -(-n // CELL_ROWS)))), width or 0


def _summed(cells: DataFrame, per_cell, replies: int) -> dict[str, np.ndarray]:
    """By group, the sums over cells of what per_cell(group, cell's row) gives: one row of numbers for each response."""
    import pyarrow as pa

    columns = cells.columns

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = per_cell(row["group"], row)
                sums[row["group"]] = sums[row["group"]] + x if row["group"] in sums else x
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x), dtype=np.int32)), pa.array([r.tobytes() for r in x])], names=["group", "response", "data"])

    out: dict[str, dict[int, np.ndarray]] = {}
    for r in X.added(cells.select(*columns).mapInArrow(run, "group string, response int, data binary"), ["group", "response"]).collect():
        out.setdefault(r.group, {})[r.response] = np.frombuffer(r.data)
    return {g: np.stack([x[k] for k in range(replies)]) for g, x in out.items()}


def _newton(cells: DataFrame, width: int, responses: int, labels_of, c: float, iterations: int) -> dict[str, np.ndarray]:
    """By group, (width + 1, responses) coefficients on the vectors as they are.

    labels_of(row) gives the vectors and labels of a cell. Each round is one pass over the vectors for all responses of all groups, with
    the loss, gradient and Hessian of each; a step that raises the loss is halved.
    """
    d = width + 1

    def moments(group, row):
        x, y = labels_of(row)
        known = ~np.isnan(y)
        ones = (y == 1).sum(0)
        return np.column_stack([known.sum(0), ones, known.T.astype(float) @ x, known.T.astype(float) @ (x * x)])

    first = _summed(cells, moments, responses)
    n, ones = ({g: m[:, k] for g, m in first.items()} for k in (0, 1))
    mean = {g: m[:, 2 : 2 + width] / np.maximum(m[:, [0]], 1) for g, m in first.items()}
    spread = {g: np.sqrt(np.maximum(m[:, 2 + width :] / np.maximum(m[:, [0]], 1) - mean[g] ** 2, 0)) for g, m in first.items()}
    for s in spread.values():
        s[s < 1e-12] = 1.0
    beta = {g: np.zeros((responses, d)) for g in first}  # on vectors scaled for each response
    last = {g: (np.full(responses, np.inf), np.zeros((responses, d)), np.zeros((responses, d))) for g in first}
    done = {g: (n[g] == 0) | (ones[g] == 0) | (ones[g] == n[g]) for g in first}  # one class: nothing to learn

    for _ in range(iterations):
        wanted = {g: np.flatnonzero(~x) for g, x in done.items()}
        most = max((len(w) for w in wanted.values()), default=0)
        if not most:
            break
        step = max(1, HESSIANS // (8 * (d * d + d + 1)))
        for at in range(0, most, step):
            some = {g: w[at : at + step] for g, w in wanted.items() if len(w) > at}
            shared = cells.sparkSession.sparkContext.broadcast((some, {g: (beta[g][w], mean[g][w], spread[g][w], n[g][w], ones[g][w]) for g, w in some.items()}))
            size = max(map(len, some.values()))

            def state(group, row, shared=shared, size=size):
                some, now = shared.value
                out = np.zeros((size, 1 + d + d * d))
                if group not in some:
                    return out
                x, y = labels_of(row)
                y = y[:, some[group]]
                for r, (b, m, s, total, positive) in enumerate(zip(*now[group])):
                    known = ~np.isnan(y[:, r])
                    z = np.column_stack([(x[known] - m) / s, np.ones(known.sum())])
                    t = y[known, r]
                    w = np.where(t == 1, total / (2 * positive), total / (2 * (total - positive)))
                    eta = z @ b
                    p = _sigmoid(eta)
                    out[r, 0] = w @ (np.logaddexp(0, eta) - t * eta)
                    out[r, 1 : 1 + d] = z.T @ (w * (p - t))
                    out[r, 1 + d :] = (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
                return out

            sums = _summed(cells, state, size)
            ridge = np.r_[np.full(width, 1.0 / c), 0.0]
            for g, w in some.items():
                before, start, move = last[g]
                for k, r in enumerate(w):
                    b = beta[g][r]
                    loss = sums[g][k, 0] + (ridge * b * b).sum() / 2
                    if loss > before[r] + 1e-12 * abs(before[r]):  # too far: back, half the way
                        move[r] = move[r] / 2
                        beta[g][r] = start[r] + move[r]
                        done[g][r] = np.abs(move[r]).max() < CLOSE
                        continue
                    gradient = sums[g][k, 1 : 1 + d] + ridge * b
                    hessian = sums[g][k, 1 + d :].reshape(d, d) + np.diag(ridge + 1e-12)
                    before[r], start[r], move[r] = loss, b, -np.linalg.solve(hessian, gradient)
                    beta[g][r] = b + move[r]
                    done[g][r] = np.abs(move[r]).max() < CLOSE
    out = {}
    for g, b in beta.items():
        raw = b[:, :-1] / spread[g]
        out[g] = np.column_stack([raw, b[:, -1] - (raw * mean[g]).sum(1)]).T
    return out


def fit_probes(df: DataFrame, labels: Sequence[str], embedding: str = "embedding", c: float = C, iterations: int = 100, group: Column | None = None) -> Probes:
    """The probes of fit_probe() for several labels 0 and 1, and for every group, in one pass over the vectors for each step of all.

    A label other than 0 and 1 leaves its row out for that probe; a probe that sees one class has coefficients 0. Rows
    without a vector or a group drop out; shorter vectors end in zeros.
    """
    cells, width = _packed(df, labels, embedding, group)
    split = lambda row: np.split(np.frombuffer(row["data"]).reshape(-1, width + len(labels)), [width], axis=1)
    return Probes(_newton(cells, width, len(labels), split, c, iterations))


def fit_permuted(df: DataFrame, label: str, order: Sequence[str], replicates: int, seed: int = 0, embedding: str = "embedding", c: float = C, iterations: int = 100) -> Probes:
    """The probe of a label, then those of replicates of it in random orders, fitted together; rows without a label 0 or 1 or a vector drop out."""
    rows = df.filter(F.col(label).isin(0, 1) & F.col(embedding).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    places = X.placed_rows(rows, ["_y", *order], [embedding, "_y"])
    width, ones = places.columns - 1, int(rows.agg(F.sum("_y")).first()[0] or 0)
    if not 0 < ones < places.n:
        return Probes({"": np.zeros((width + 1, 1 + replicates))})
    cuts = X.border_keys(places, [places.n - ones], range(replicates), seed)[:, 0]

    def split(row):
        m = np.frombuffer(row["data"]).reshape(-1, width + 1)
        at = row["first"] + np.arange(len(m))
        return m[:, :width], np.column_stack([m[:, width], *((X.keys_of(seed, b, at) >= k).astype(float) for b, k in enumerate(cuts))])

    return Probes(_newton(places.table.withColumn("group", F.lit("")), width, 1 + replicates, split, c, iterations))


def aurocs(scored: DataFrame, findings: Sequence[str], scores: str = "scores", by: Sequence[str] = ()) -> DataFrame:
    """(by..., finding, auroc, n_positive, n_negative) of the scores in an array against the labels of the same order, all ranked in one job."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("finding"), F.col(f).cast("double").alias("_label"), F.col(scores)[i].alias("_score")) for i, f in enumerate(findings))))
    return auroc(scored.select(*by, each.alias("r")).select(*by, "r.*"), "_label", "_score", [*by, "finding"])


def _plain_auroc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve by average ranks."""
    _, code, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - n + (n + 1) / 2)[code]
    p = (y == 1).sum()
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))) if 0 < p < len(y) else float("nan")


def _weighted_auroc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Area under the ROC curve of rows that count w times; NaN with a single class."""
    _, code = np.unique(score, return_inverse=True)
    p, q = (np.bincount(code, weights=w * (y == k)) for k in (1, 0))
    return float(p @ (np.cumsum(q) - q / 2) / (p.sum() * q.sum())) if p.sum() and q.sum() else float("nan")


def finding_aurocs(train: DataFrame, test: DataFrame, findings: Sequence[str], c: float = C) -> DataFrame | None:
    """(finding, auroc, n_positive, n_negative) of a probe for each finding with enough rows; None if there is none. The probes are fitted together."""
    sizes = lambda df: df.agg(*(x for f in findings for x in (F.count(F.when(F.col(f).isin(0, 1), 1)), F.countDistinct(F.when(F.col(f).isin(0, 1), F.col(f)))))).first()
    a, b = sizes(train), sizes(test)
    good = [f for i, f in enumerate(findings) if a[2 * i] >= LEAST_TRAIN and b[2 * i] >= LEAST_TEST and a[2 * i + 1] == b[2 * i + 1] == 2]
    return aurocs(fit_probes(train, good, c=c).scores(test), good) if good else None


def budget_draw(df: DataFrame, label: str, n: int, draw: int, seed: int, id_col: str) -> DataFrame:
    """About n labelled rows with the table's share of positives, at least two of each class, other ones for every draw."""
    r = df.filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    positives = int(np.clip(round(n * (r.p or 0.0)), 2, max(2, n - 2)))
    key = hash_key(f"{seed}:{draw}", F.col(id_col))
    take = lambda y, m: df.filter(F.col(label) == y).orderBy(key, id_col).limit(m)
    return take(1, positives).unionByName(take(0, n - positives))


def accuracy(scored: DataFrame, label: str) -> DataFrame:
    """Share of right predictions, and of the most frequent class."""
    counts = scored.groupBy(label).count().agg(F.max("count").alias("_most"))
    return scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n")).crossJoin(counts).select("accuracy", (F.col("_most") / F.col("n")).alias("majority"), "n")  # one row each


def multiclass_accuracy(train: DataFrame, test: DataFrame, label: str, embedding: str = "embedding", least: int = LEAST_TRAIN) -> DataFrame | None:
    """accuracy() of a probe of several classes, those with at least `least` training rows; None below two of them or without test rows of theirs."""
    kept = [r[0] for r in train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(label).collect()]
    own = test.filter(F.col(label).isin(*kept)) if kept else test.limit(0)
    if len(kept) < 2 or own.isEmpty():
        return None
    number = F.create_map(*(F.lit(x) for i, k in enumerate(kept) for x in (k, i)))[F.col(label)]
    probe = fit_probe(train.filter(F.col(label).isin(*kept)).withColumn("_class", number), "_class", embedding)
    return accuracy(probe.score(own.withColumn("_class", number), embedding), "_class").withColumn("n_classes", F.lit(len(kept)))


def budget_refits(train: DataFrame, test: DataFrame, label: str, n: int, draws: int = 20, seed: int = 0, id_col: str = "case_id", c: float = 1.0) -> DataFrame:
    """(draw, auroc, n_positive, n_negative): probes on small stratified draws, all fitted together and tested on the same rows."""
    of = [budget_draw(train, label, n, b, seed, id_col).select(id_col, F.lit(b).alias("_draw")) for b in range(draws)]
    drawn = of[0]
    for one in of[1:]:
        drawn = drawn.unionByName(one)
    rows = train.join(drawn.groupBy(id_col).agg(F.collect_set("_draw").alias("_draws")), id_col)  # at most n of each draw
    names = [f"_y{b}" for b in range(draws)]
    rows = rows.withColumns({c_: F.when(F.array_contains("_draws", b), F.col(label)) for b, c_ in enumerate(names)})
    scored = fit_probes(rows, names, c=c).scores(test.filter(F.col(label).isin(0, 1)))
    each = F.posexplode("scores").alias("draw", "_score")
    return auroc(scored.select(label, each), label, "_score", ["draw"])


def transfer_matrix(train: DataFrame, test: DataFrame, label: str, encoders: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """(enc_train, enc_eval, auroc, oracle_auroc, retention, chance_corrected): each encoder's probe on every encoder's vectors.

    The vectors must be comparable between encoders, as relative ones are. The encoders' probes are fitted
    together, and score each vector in one pass.
    """
    fitted = fit_probes(train.filter(F.col("encoder").isin(*encoders)), [label], embedding, group=F.col("encoder")).coefficients
    known = [e for e in encoders if e in fitted]
    if not known:
        return train.sparkSession.createDataFrame([], "enc_eval string, enc_train string, auroc double, oracle_auroc double, retention double, chance_corrected double")
    scored = Probes({"": np.column_stack([fitted[e] for e in known])}).scores(test.filter(F.col("encoder").isin(*encoders)), embedding=embedding)
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("enc_train"), F.col("scores")[i].alias("_score")) for i, e in enumerate(known)))).alias("r")
    found = auroc(scored.select(F.col("encoder").alias("enc_eval"), label, each).select("enc_eval", label, "r.*"), label, "_score", ["enc_train", "enc_eval"])
    out = found.select("enc_train", "enc_eval", "auroc")
    oracle = out.filter("enc_train = enc_eval").select("enc_eval", F.col("auroc").alias("oracle_auroc"))
    joined = out.join(oracle, "enc_eval")
    return joined.withColumn("retention", retention(F.col("auroc"), F.col("oracle_auroc"))).withColumn("chance_corrected", chance_corrected(F.col("auroc"), F.col("oracle_auroc")))


def mapped(df: DataFrame, matrix: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """df with its vectors sent through an affine map of (d + 1) rows."""
    import pyarrow as pa

    names, at = df.columns, df.columns.index(embedding)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(embedding, T.ArrayType(T.DoubleType())) if f.name == embedding else f for f in df.schema])

    def run(batches):
        for batch in batches:
            v = batch.column(at)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            y = x @ matrix[:-1] + matrix[-1]
            cols = list(batch.columns)
            cols[at] = pa.array(list(y), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def probe_reference(rows: DataFrame, label: str, subject: str, id_col: str, replicates: int, seed: int = 0, most: int = 8000, least: int = 200) -> DataFrame | None:
    """One row: a probe's AUROC on subjects that it has not seen, with a bootstrap over subjects and its reference under shuffled training labels.

    Training and test rows are at most `most` each, the first by hash. None below `least` labelled
    rows, 100 training and 50 test rows, or with one class on a side. The probe and all replicates are fitted together; every task
    holds the test rows and scores its share of the replicates.
    """
    kept = finite_rows(rows.filter(F.col(label).isin(0, 1)))
    if not usable(kept, label, least):
        return None
    parts = unit_split(kept, subject, seed)
    train, test = (cut(capped(parts.filter(F.col("part") == p), most, seed, id_col)) for p in ("train", "test"))
    if not usable(train, label, 100) or not usable(test, label, 50):
        return None
    coefficients = fit_permuted(train, label, [id_col], replicates, seed).coefficients[""]
    held = test.select(subject, F.col(label).cast("double").alias("_y"), F.col("embedding").cast("array<double>").alias("_x")).orderBy(subject, id_col).collect()  # at most `most`
    blank = {"", "nan", "none"}
    if any(r[0] is None or str(r[0]).strip().lower() in blank for r in held):
        raise ValueError("a row has no cluster")
    x, y = np.array([[*r["_x"], 1.0] for r in held]), np.array([r["_y"] for r in held])
    _, cluster = np.unique([str(r[0]) for r in held], return_inverse=True)
    shared = rows.sparkSession.sparkContext.broadcast((x, y, cluster, coefficients))

    def reference(b: int) -> float:
        x, y, _, coefficients = shared.value
        return _plain_auroc(x @ coefficients[:, b + 1], y)

    def resampled(b: int) -> float:
        x, y, cluster, coefficients = shared.value
        w = X.weights(seed, b, 0, cluster.max() + 1, np.ones(cluster.max() + 1, int))[cluster]
        return _weighted_auroc(x @ coefficients[:, 0], y, w.astype(float))

    found = X.by_replicate(rows, replicates, reference, ())
    std, ci_low, ci_high, _ = spread_of(X.by_replicate(rows, 200, resampled, ())[1:])
    own, draws = float(found[0]), found[1:]
    low, high = (float(v) for v in np.percentile(draws, [2.5, 97.5]))
    p = float((X.at_least(draws, own).sum() + 1) / (len(draws) + 1.0))
    out = (own, std, ci_low, ci_high, float(draws.mean()), low, high, own - float(draws.mean()), p, train.count(), len(y), int(y.sum()))
    names = "auroc double, std double, ci_low double, ci_high double, reference_mean double, reference_ci_low double, reference_ci_high double, excess double, p_raw double, n_train long, n_test long, n_positive long"
    return rows.sparkSession.createDataFrame([out], names)


def map_budgets(train: DataFrame, test: DataFrame, findings: Sequence[str], source: str, target: str, budgets: Sequence[int], id_col: str = "case_id", seed: int = 0) -> DataFrame:
    """(enc_src, enc_tgt, finding, n_map_images, auroc, oracle_auroc, retention, chance_corrected) as the map sees more cases.

    The budgets are prefixes of one order of the training cases, that of a hash, so a larger one holds the
    smaller. The target's probes are fitted once. A budget below the larger width plus 2 fails, as the map
    would be underdetermined, and so does one that has fewer cases.
    """
    both = finite_rows(train.filter(F.col("encoder").isin(source, target)))
    shared = both.groupBy(id_col).agg(F.countDistinct("encoder").alias("_n")).filter("_n = 2").select(id_col)
    order = positions(shared.withColumn("_key", hash_key(seed, F.col(id_col))), ["_key", id_col], "_place").select(id_col, "_place")
    ranked_rows = cut(both.join(order, id_col))
    width, cases = both.agg(F.max(F.size("embedding"))).first()[0] or 0, shared.count()
    if bad := [b for b in budgets if b < width + 2 or b > cases]:
        raise ValueError(f"map budgets {bad} are below the width plus 2 or above the cases")
    fitting = ranked_rows.filter((F.col("encoder") == target) & (F.col("_place") < max(budgets)))
    own, moved, out = test.filter(F.col("encoder") == target), {}, None
    for b in budgets:
        matrix = affine_map(grams(ranked_rows.filter(F.col("_place") < b).select("encoder", F.col(id_col).alias("case_id"), "embedding")), source, target)
        moved[b] = mapped(test.filter(F.col("encoder") == source), matrix)
    good = [f for f in findings if usable(fitting, f, LEAST_TRAIN) and usable(own, f, LEAST_TEST)]
    if good:
        probes = fit_probes(fitting, good)
        every = probes.scores(own).select(*good, "scores").withColumn("n_map_images", F.lit(None).cast("int"))
        for b in budgets:
            every = every.unionByName(probes.scores(moved[b]).select(*good, "scores").withColumn("n_map_images", F.lit(b)))
        found = cut(aurocs(every, good, by=["n_map_images"]))
        oracle = found.filter("n_map_images IS NULL").select(F.col("finding").alias("_of"), F.col("auroc").alias("oracle_auroc"))
        out = found.filter("n_map_images IS NOT NULL").join(F.broadcast(oracle), F.col("finding") == F.col("_of"))  # a row for each finding
        out = out.select(F.lit(source).alias("enc_src"), F.lit(target).alias("enc_tgt"), "finding", "n_map_images", "auroc", "oracle_auroc")
    if out is None:
        return train.sparkSession.createDataFrame([], "enc_src string, enc_tgt string, finding string, n_map_images int, auroc double, oracle_auroc double, retention double, chance_corrected double")
    return out.withColumn("retention", retention(F.col("auroc"), F.col("oracle_auroc"))).withColumn("chance_corrected", chance_corrected(F.col("auroc"), F.col("oracle_auroc")))


def budget_summary(sweep: DataFrame) -> DataFrame:
    """Medians and quartiles of a map-budget sweep by number of cases."""
    middle = lambda c, q=0.5: F.percentile(c, q)
    return sweep.groupBy("n_map_images").agg(F.count("auroc").alias("n_rows"), middle("auroc").alias("median_auroc"), middle("oracle_auroc").alias("median_oracle_auroc"), middle("retention").alias("median_retention"), middle("retention", 0.25).alias("q25_retention"), middle("retention", 0.75).alias("q75_retention"), middle("chance_corrected").alias("median_chance_corrected"))
