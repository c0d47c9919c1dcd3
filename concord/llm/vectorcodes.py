"""Vector code compression: the parts of quantised vectors are coded by the nearest entries of codebooks.

Every partition builds kd-trees over its parts once and writes them. Each round of Lloyd's
algorithm filters the codebooks down those trees; tasks give the counts and sums of entries,
and the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.bitsliced import quantised
from concord.llm.common import materialise
from concord.llm.kdtree import PartTree

SCALE = 1024
PARTS = 4
#: Entries of a codebook, whose numbers are two hex digits.
ENTRIES = 256
ROUNDS = 4
#: Rows of a block at most, and components.
BLOCK_ROWS = 16384
BLOCK_VALUES = 1 << 22
#: Labels whose sums are copied to all tasks at most; more are joined by a shuffle.
FEW_LABELS = 100_000

_SUMS = "part int, entry int, n long, sums array<decimal(38,0)>"


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part a matrix of integers."""

    entries: list[np.ndarray]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.ravel()).encode()).hexdigest()


def _kept(vectors: DataFrame, vec_id: str, embedding: str, label: str | None) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col(f"`{embedding}`").isNotNull() & ~F.exists(f"`{embedding}`", bad)
    own = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    return vectors.filter(usable).select(F.col(f"`{vec_id}`").alias("vec_id"), own.alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))


def _matrix(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Quantised rows, whose shorter ones end in zeros: doubles if all of the work on them is exact, else Python's integers."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = quantised(lists.flatten().to_numpy(zero_copy_only=False), scale)
    rows = np.zeros((len(sizes), width), values.dtype)
    rows[np.arange(width) < sizes[:, None]] = values
    return exact(rows)


def exact(rows: np.ndarray) -> np.ndarray:
    most = max((abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))), default=0)
    small = 16 * most * most * max(1, rows.shape[1]) < 1 << 53 and most * BLOCK_ROWS < 1 << 53
    return rows.astype(np.float64 if small else object)


def _paired(tree: PartTree, entries: np.ndarray) -> tuple[PartTree, np.ndarray]:
    """Both in Python's integers, if one of them is."""
    if entries.dtype == object and tree.points.dtype != object:
        for name in ("points", "lows", "highs", "sums"):
            setattr(tree, name, _whole(getattr(tree, name)))
    elif tree.points.dtype == object:
        entries = _whole(entries)
    return tree, entries


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _blocks(kept: DataFrame, n: int, width: int, parts: int, scale: int) -> DataFrame:
    schema = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), T.StructField("trees", T.BinaryType())])
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, width)))

    def run(batches):
        ids, labels, matrices = [], [], []

        def block():
            whole = np.concatenate(matrices)
            trees = pickle.dumps([PartTree(p) for p in np.split(whole, parts, axis=1)])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.concat_arrays(a))
            out = pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([trees], pa.binary())], names=schema.names)
            ids.clear(), labels.clear(), matrices.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if matrices and sum(map(len, matrices)) + piece.num_rows > rows:
                    yield block()
                ids.append(piece.column(0))
                labels.append(piece.column(1))
                matrices.append(_matrix(pa.concat_arrays([piece.column(2)]), width, scale))
        if matrices:
            yield block()

    return materialise(kept.repartition(n).mapInArrow(run, schema), "trees")


def _round(trees: DataFrame, books: Codebooks) -> list:
    """Counts and sums of every entry that is used, one row each: at most PARTS x ENTRIES come to the driver."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        counts: list = [0] * len(shared.value.entries)
        sums: list = [0] * len(counts)
        for batch in batches:
            for data in batch.column(0):
                for k, tree in enumerate(pickle.loads(data.as_py())):
                    tree, entries = _paired(tree, shared.value.entries[k])
                    _, n, s, _ = tree.assign(entries)
                    counts[k], sums[k] = counts[k] + n, sums[k] + _whole(s)
        rows = [(k, e, int(counts[k][e]), [Decimal(int(x)) for x in sums[k][e]]) for k in range(len(counts)) if not np.isscalar(counts[k]) for e in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))))], names=["part", "entry", "n", "sums"])

    width = books.entries[0].shape[1]
    added = F.array(*(F.sum(F.col("sums")[i]).cast("decimal(38,0)") for i in range(width)))
    return trees.select("trees").mapInArrow(run, _SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums")).collect()


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks, DataFrame] | None:
    """(codebooks after some rounds, the written trees that encode() reads); None without usable vectors."""
    kept = _kept(vectors, vec_id, embedding, label)
    n, width = kept.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    width = -(-max(1, width) // parts) * parts
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // width))
    trees = _blocks(kept, -(-n // rows), width, parts, scale)
    first = [r.embedding for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    books = Codebooks(np.split(_matrix(pa.array(first, pa.list_(pa.float64())), width, scale), parts, axis=1))
    for _ in range(rounds):
        moved = [_whole(e).copy() for e in books.entries]
        for r in _round(trees, books):
            moved[r.part][r.entry] = [int(s) // r.n for s in r.sums]
        books = Codebooks([exact(e) for e in moved])
    return books, trees


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the trees."""
    shared = trees.sparkSession.sparkContext.broadcast(books)
    element = lambda c: trees.schema[c].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", element("ids")), T.StructField("label", element("labels")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = max(2, len(f"{max(1, max(len(e) for e in books.entries) - 1):x}"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, errors = [], 0
                for k, tree in enumerate(pickle.loads(batch.column(2)[i].as_py())):
                    tree, entries = _paired(tree, shared.value.entries[k])
                    own = tree.assign(entries)[0]
                    away = tree.original() - entries[own]
                    codes.append(np.array([f"{c:0{digits}x}" for c in range(len(entries))])[own])
                    errors = errors + (away * away).sum(1)
                code = ["".join(c) for c in zip(*codes)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), pa.array([int(e) for e in errors], pa.int64())], names=schema.names)

    return trees.select("ids", "labels", "trees").mapInArrow(run, schema)


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    Components become floor(scale * x). The codebooks start as the parts of the vectors of the smallest ids
    (rows that repeat an id by their vectors, rows without an id last) and go through rounds of assignment
    to the nearest entry, ties to the lower number, and update to floor(mean). Vectors that are null or hold a null
    or non-finite component drop out; those that are shorter than the longest, or than a width that `parts` divides,
    count as ending in zeros. Null labels are one label. An empty table gives no rows; other columns
    do not matter. An error that leaves a long fails the query.
    """
    found = fit(vectors, vec_id, embedding, label, parts, entries, rounds, scale)
    if found is None:
        return vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books, trees = found
    rows = materialise(encode(trees, books), "codes")
    sums = materialise(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    other = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return rows.join(other, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
