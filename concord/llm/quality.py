"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every word occurrence is a feature of its bucket with value 1 / words; statistics of the text's
structure and the declared length are standardised features. All pairs interact through
low-rank factors, and the sum over pairs is taken in linear time as half the difference of
the squared sum and the sum of squares.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import map_batches, materialise, spread_over
from concord.operators.resampling import added

BUCKETS = 8192
FACTORS = 8
#: Labelled rows are dealt into shards of this many to twice as many, which are trained on side by side.
SHARD_ROWS = 4096
EPOCHS = 8
BATCH = 128
RATE = 0.02
DECAY = 1e-4
#: Words that a Python worker remembers.
CACHE = 300_000
THRESHOLD = 0.7
#: Averages of shards are taken of whole multiples of 1 / UNITS, so that their sums do not depend on an order.
UNITS = float(1 << 36)

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digit", "punctuation", "exclaim", "bar", "symbol",
    "unique_words", "repeated_next", "unique_lines", "line_words", "declared",
]

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_PUNCT = np.array([b in b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""" for b in range(256)])
_SYMBOL = np.array([b in b"#$%&*@^~<>=+" for b in range(256)])
_SCORED = [T.StructField("score", T.DoubleType())]


def statistics(text: str, words: list[str], declared: int | None) -> list[float]:
    """The values of STATISTICS for one text; declared is its length by the table, which may be null."""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    share = lambda mask: float(seen[mask].sum()) / size
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / n, share(_UPPER), share(_DIGIT), share(_PUNCT), seen[0x21] / n, seen[0x7C] / n, share(_SYMBOL),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        0.0 if declared is None or declared < 0 else float(np.log1p(declared) - np.log1p(len(text))),
    ]


class Words(dict):
    """Bucket of each word; remembers the first CACHE of them."""

    def __missing__(self, word: str) -> int:
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < CACHE:
            self[word] = at
        return at


@dataclass
class Machine:
    """Weights and factors of the buckets, then of the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, at: np.ndarray, stats: np.ndarray) -> float:
        """Probability of label 1 for one text."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        own = self.factors[BUCKETS:]
        linear = self.bias + float(x @ self.linear[BUCKETS:])
        sums, squares = x @ own, (x * x) @ (own * own)
        if at.size:
            each = np.bincount(at, minlength=BUCKETS) if at.size > BUCKETS else None
            v = self.factors[:BUCKETS] if each is not None else self.factors[at]
            w = self.linear[:BUCKETS] if each is not None else self.linear[at]
            weight = each if each is not None else np.ones(at.size)
            linear += float(weight @ w) / at.size
            sums = sums + weight @ v / at.size
            squares = squares + weight @ (v * v) / at.size**2
        logit = linear + 0.5 * float((sums * sums - squares).sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


@dataclass
class _Shard:
    """Rows of one shard: buckets and counts one after the other, where each row's end, labels and statistics."""

    number: int
    ids: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    stats: np.ndarray


_PACKED = "shard int, ids binary, counts binary, ends binary, labels binary, stats binary"


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a shard in the order of their ids as one row."""
    table = table.sort_by("id")
    ids, counts = ([np.frombuffer(x.as_buffer(), "<i4") for x in table.column(c)] for c in ("at", "n"))
    stats = np.array(table.column("stats").combine_chunks().flatten(), np.float64)
    parts = np.concatenate(ids).astype("<i4"), np.concatenate(counts).astype("<i4"), np.cumsum([len(x) for x in ids]).astype("<i8"), np.array(table.column("y"), "<f8"), stats.astype("<f8")
    return pa.table([table.column("shard").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["shard", "ids", "counts", "ends", "labels", "stats"])


def _shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            number, *data = (column[i].as_py() for column in batch.columns)
            ids, counts, ends, labels, stats = (np.frombuffer(x, kind) for x, kind in zip(data, ("<i4", "<i4", "<i8", "<f8", "<f8")))
            yield _Shard(number, ids, counts, ends, labels, stats.reshape(len(labels), -1))


def _trained(shard: _Shard, state: list[np.ndarray], epochs: range, mean: np.ndarray, scale: np.ndarray, seed: int) -> list[np.ndarray]:
    """The state (bias, linear and factors, then both moments of each, then the steps) after some epochs over the rows of a shard."""
    x_stats = np.clip((shard.stats - mean) / scale, -8, 8)
    n, d = len(shard.labels), BUCKETS + x_stats.shape[1]
    state = [x.copy() for x in state]
    theta, first, second, steps = state[:3], state[3:6], state[6:9], state[9]
    starts = np.r_[0, shard.ends[:-1]]
    for epoch in epochs:
        order = np.random.default_rng([seed, epoch, shard.number]).permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            x, x2 = np.zeros((len(rows), d)), np.zeros((len(rows), d))
            for k, i in enumerate(rows):
                ids, c = (a[starts[i] : shard.ends[i]] for a in (shard.ids, shard.counts))
                total = max(1, c.sum())
                x[k, ids], x2[k, ids] = c / total, c / total**2
            x[:, BUCKETS:], x2[:, BUCKETS:] = x_stats[rows], x_stats[rows] ** 2
            bias, w, v = theta
            sums = x @ v
            logit = bias[0] + x @ w + 0.5 * (sums**2 - x2 @ (v * v)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - shard.labels[rows]) / len(rows)
            grads = [np.array([g.sum()]), x.T @ g + DECAY * w, x.T @ (g[:, None] * sums) - (x2.T @ g)[:, None] * v + DECAY * v]
            steps += 1
            for t, grad, a, b in zip(theta, grads, first, second):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                t -= RATE * (a / (1 - 0.9 ** steps[0])) / (np.sqrt(b / (1 - 0.999 ** steps[0])) + 1e-8)
    return state


def _train(table: DataFrame, seed: int = 7) -> Machine | None:
    """A machine trained on all shards: each goes over its rows from the common state, then the states are averaged, EPOCHS times.

    A single shard has nothing to be averaged with and makes all epochs at once. Second moments are averaged as roots.
    """
    moments = "n long, y double, sums binary, squares binary, shard int"

    def summed(batches):
        for s in _shards(batches):
            own = s.stats.mean(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(s.labels)], pa.int64()), pa.array([float(s.labels.sum())]), pa.array([own.tobytes()]), pa.array([((s.stats - own) ** 2).sum(0).tobytes()]), pa.array([s.number], pa.int32())], names=["n", "y", "sums", "squares", "shard"])

    found = sorted(table.mapInArrow(summed, moments).collect(), key=lambda r: r.shard)  # a row of numbers for each shard
    if not found:
        return None
    n, means, squares = np.array([r.n for r in found], float), np.array([np.frombuffer(r.sums) for r in found]), np.array([np.frombuffer(r.squares) for r in found])
    mean = n @ means / n.sum()
    scale = np.sqrt((squares.sum(0) + n @ (means - mean) ** 2) / n.sum()) + 1e-6
    rate, d = float(np.clip(sum(r.y for r in found) / n.sum(), 0.01, 0.99)), BUCKETS + len(mean)
    theta = [np.array([np.log(rate / (1 - rate))]), np.zeros(d), np.random.default_rng(seed).normal(0, 0.05, (d, FACTORS))]
    state = [*theta, *(np.zeros_like(t) for _ in range(2) for t in theta), np.zeros(1)]
    shapes, ends = [x.shape for x in state], np.cumsum([x.size for x in state])
    context = table.sparkSession.sparkContext
    parts = table.coalesce(spread_over(table.sparkSession))
    rounds = [range(EPOCHS)] if len(found) == 1 else [range(e, e + 1) for e in range(EPOCHS)]
    for epochs in rounds:
        shared = context.broadcast((state, epochs, mean, scale))

        def run(batches):
            start, own, mean, scale = shared.value
            total = None
            for s in _shards(batches):
                new = _trained(s, start, own, mean, scale, seed)
                new[6:9] = [np.sqrt(x) for x in new[6:9]]
                units = np.rint(np.concatenate([x.ravel() for x in new]) * UNITS)
                total = units if total is None else total + units
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], names=["all", "data"])

        (row,) = added(parts.mapInArrow(run, "all int, data binary"), ["all"]).collect()
        state = [x.reshape(shape) for x, shape in zip(np.split(np.frombuffer(row.data) / (UNITS * len(found)), ends[:-1]), shapes)]
        state[6:9] = [x**2 for x in state[6:9]]
        shared.unpersist()
    return Machine(float(state[0][0]), state[1], state[2], mean, scale)


def _features(body: str | None, declared: int | None, buckets: Words) -> tuple[np.ndarray, list[float]]:
    text = body or ""
    words = text.split()
    return np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)), statistics(text, words, declared)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", label: str = "quality", shard_rows: int = SHARD_ROWS) -> Machine | None:
    """A machine for P(label = 1), or None without a labelled row where learn is true.

    All such rows are learned from, each read whole. They are dealt into shards of shard_rows to about twice as many by a hash of their id,
    and tasks train on the shards; what comes to the driver is the average of their machines. A null text counts as empty; labels other than 0 and 1 and null ids teach
    nothing, of labels that differ for an id the larger holds, and of rows that share an id the one with the first text; other columns do not matter.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("of")).agg(F.max(label).alias("y"))
    declared = F.col(length).cast("long") if length in docs.columns else F.lit(None).cast("long")
    rows = docs.filter(learn).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), declared.alias("declared"))
    shards = max(1, known.join(rows.select("id"), F.col("of") == F.col("id"), "left_semi").count() // shard_rows)
    rows = rows.join(known, rows["id"] == known["of"]).select("id", "y", "text", "declared").repartition(spread_over(docs.sparkSession), "id")
    one = F.min(F.struct("text", "declared"))  # of the rows that share an id
    rows = rows.groupBy("id", "y").agg(one.alias("row")).select("id", "y", "row.*")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        buckets = Words()
        for batch in batches:
            out = []
            for key, y, body, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                at, stats = _features(body.as_py(), size, buckets)
                ids, n = np.unique(at, return_counts=True)
                out.append((str(key), y, ids.astype("<i4").tobytes(), n.astype("<i4").tobytes(), stats))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())))], names=schema.names)

    features = rows.select(F.col("id").cast("string"), F.col("y").cast("int"), "text", "declared").mapInArrow(run, schema)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    dealt = features.withColumn("shard", shard).repartitionByRange(min(shards, spread_over(docs.sparkSession)), "shard")
    return _train(materialise(dealt.groupBy("shard").applyInArrow(_pack, _PACKED), "shards"))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", length: str = "n_chars", keeps: list[str] | None = None) -> DataFrame:
    """The columns `keeps` of docs, score and predicted (1 from THRESHOLD on).

    A null text is scored as empty, and empty texts by their statistics; a null or absent declared
    length counts as the true one; without a machine every score is 0.5. Rows that repeat are
    scored alike; an empty table gives no rows; columns of docs with the name of a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    reads = [text, *([length] if length in docs.columns else [])]

    def make():
        m, buckets = shared.value, Words()

        def run(cols):
            sizes = cols[length].to_pylist() if length in cols else [None] * len(cols[text])
            out = []
            for body, size in zip(cols[text], sizes):
                at, stats = _features(body.as_py(), None if size is None else int(size), buckets)
                out.append(m.score(at, np.array(stats)) if m else 0.5)
            return {"score": pa.array(out, pa.float64())}

        return run

    kept = [c for c in (keeps if keeps is not None else docs.columns) if c != "predicted"]
    out = map_batches(docs, make, reads, kept, _SCORED)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
