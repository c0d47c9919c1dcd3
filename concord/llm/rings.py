"""Search by one-dimensional distance keys, for the largest inner products.

A component is added to every vector that brings all to one length, so that the largest inner
product with a query is the smallest distance from it. Each vector is stored in the order of its
key: the nearest of a few pivots, and the distance from it. What lies within some distance of a
query has, at every pivot, a key in one interval around the query's own distance, a ring; so blocks of
consecutive keys are read or passed over by their first and last key alone. A scan answers for all
rows whose score reaches a threshold, however few blocks that takes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.bitsliced import quantised, usable
from concord.llm.common import materialise

SCALE = 256
#: Rows of a block, and queries that meet a block at once; each also holds at most so many components.
BLOCK_ROWS = 8192
SET_ROWS = 512
VALUES = 1 << 22
#: The pivots are centres of so many rows at most, taken by hash; one pivot for so many rows of the table, and no more than that.
SAMPLE_ROWS = 4096
ROWS_A_PIVOT = 4096
PIVOTS = 64
#: Blocks whose keys are copied to all tasks at most; those of more are joined by a shuffle.
FEW_BLOCKS = 1 << 20
#: Share of the common length by which intervals are widened, as distances are rounded.
SLACK = 1e-6

_KEYED = "id long, label string, embedding array<double>, anchor boolean, pivot int, away double"
_BLOCK = "block long, pivot int, low double, high double, ids binary, labels array<string>, data binary"
_SET = "set long, ids binary, labels array<string>, data binary, pivots binary, keys binary"
_RING = "set long, pivot int, low double, high double"
_HIT = "set long, at int, slot int, id long, score long"


@dataclass(frozen=True)
class Space:
    """Pivots with their added component, the squared common length, the width of vectors."""

    pivots: np.ndarray
    length2: float
    width: int
    scale: int

    def distances(self, rows: np.ndarray, added: np.ndarray) -> np.ndarray:
        """From every row, with its added component, to every pivot."""
        x = np.column_stack([rows.astype(np.float64), added])
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * (x @ self.pivots.T), 0))

    def added(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.length2 - (rows.astype(np.float64) ** 2).sum(1), 0))


def matrix_of(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Quantised rows; shorter vectors end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = quantised(lists.flatten().to_numpy(zero_copy_only=False), scale)
    rows = np.zeros((len(sizes), width), values.dtype)
    rows[np.arange(width) < sizes[:, None]] = values
    return rows


def dumped(rows: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them."""
    most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    small = next((t for t, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 63)) if most < 1 << bits), object)
    return pickle.dumps(rows.astype(small))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles, or in Python's integers where those are not enough."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    exact = most[0] * most[1] * max(1, a.shape[1]) < 1 << 53
    kind = np.float64 if exact else object
    return a.astype(kind) @ b.astype(kind).T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest allowed scores, all if fewer; ties to the first columns."""
    k = min(k, scores.shape[1])
    if not k or not len(scores):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    masked = np.where(allowed, scores, -np.inf)
    least = np.partition(masked, masked.shape[1] - k, axis=1)[:, [masked.shape[1] - k]]
    more, ties = masked > least, masked == least
    return np.nonzero((more | (ties & (np.cumsum(ties, 1) <= k - more.sum(1, keepdims=True)))) & allowed)


def _centres(rows: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Some rounds of means, from rows evenly spread over the sample."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * (rows @ centres.T)).argmin(1)
        centres = np.stack([rows[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres


def space_of(rows: DataFrame, scale: int) -> tuple[Space, int] | None:
    """(space, number of rows) of (id, embedding); None without rows. The pivots are fitted on a bounded sample."""
    square = F.aggregate(F.transform("embedding", lambda x: F.floor(x * scale).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(square)).first()
    if not n:
        return None
    width = max(1, width)
    sample = rows.orderBy(F.xxhash64("id"), "id", "embedding").limit(max(1, min(SAMPLE_ROWS, VALUES // width))).select("embedding").collect()
    matrix = matrix_of(pa.array([r.embedding for r in sample], pa.list_(pa.float64())), width, scale)
    space = Space(np.zeros((0, width + 1)), longest * (1 + 1e-9), width, scale)
    full = np.column_stack([matrix.astype(np.float64), space.added(matrix)])
    return Space(_centres(full, min(PIVOTS, -(-n // ROWS_A_PIVOT), len(full))), space.length2, width, scale), n


@dataclass(frozen=True)
class Rings:
    """index: blocks of rows in the order of their keys; sets: blocks of queries."""

    space: Space
    index: DataFrame
    sets: DataFrame
    blocks: int


def build(vectors: DataFrame, vec_id: str, embedding: str, label: str, is_query: Column, scale: int = SCALE) -> Rings | None:
    """The index of all usable rows with a label and the sets of those that are queries too; None without rows."""
    rows = vectors.filter(usable(vec_id, embedding) & F.col(label).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("anchor"))
    found = space_of(rows, scale)
    if found is None:
        return None
    space, n = found
    shared = vectors.sparkSession.sparkContext.broadcast(space)

    def keyed(batches):
        for batch in batches:
            matrix = matrix_of(pa.concat_arrays([batch.column(2)]), shared.value.width, scale)
            away = shared.value.distances(matrix, shared.value.added(matrix))
            pivot = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(away[np.arange(len(pivot)), pivot])], names=["id", "label", "embedding", "anchor", "pivot", "away"])

    keys = materialise(rows.mapInArrow(keyed, _KEYED), "keys")
    order, value_rows = ["pivot", "away", "id"], max(1, VALUES // space.width)
    block_rows, set_rows = min(BLOCK_ROWS, value_rows), min(SET_ROWS, value_rows)
    packed = lambda df, size, run, schema: materialise(df.repartitionByRange(-(-max(1, df.count()) // size), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "rings")
    index = packed(keys, block_rows, _packer(shared, block_rows, True), _BLOCK)
    sets = packed(keys.filter("anchor"), set_rows, _packer(shared, set_rows, False), _SET)
    return Rings(space, index, sets, index.count())


def _packer(shared, size: int, by_pivot: bool) -> Callable:
    """Blocks of at most `size` consecutive rows, in the index of one pivot, each in the order of its ids."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks().sort_by("id").to_batches(max_chunksize=size + 1)[0]
            held.clear()
            number += 1
            ids, labels, pivot, away = whole.column("id").to_numpy().astype("<i8"), whole.column("label"), whole.column("pivot").to_numpy(), whole.column("away").to_numpy()
            data = dumped(matrix_of(pa.concat_arrays([whole.column("embedding")]), shared.value.width, shared.value.scale))
            strings = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([labels]))
            if by_pivot:
                cols = [pa.array([number]), pa.array([pivot[0]], pa.int32()), pa.array([away.min()]), pa.array([away.max()]), pa.array([ids.tobytes()]), strings, pa.array([data])]
                return pa.RecordBatch.from_arrays(cols, names=["block", "pivot", "low", "high", "ids", "labels", "data"])
            cols = [pa.array([number]), pa.array([ids.tobytes()]), strings, pa.array([data]), pa.array([pivot.astype("<i4").tobytes()]), pa.array([away.astype("<f8").tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["set", "ids", "labels", "data", "pivots", "keys"])

        for batch in batches:
            pivots = batch.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1 if by_pivot else []), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (sum(h.num_rows for h in held) == size or (by_pivot and held[0].column("pivot")[0].as_py() != pivots[a])):
                        yield block()
                    take = min(b - a, size - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield block()

    return run


def scan(rings: Rings, wanted: DataFrame, choose: Callable) -> DataFrame:
    """(set, at, slot, id, score) of what `choose` takes from every block that a query's rings meet, for each block.

    wanted holds (set, at, threshold, more): the query at place `at` of a set asks for the rows whose score
    reaches the threshold, or with NULL for those around its own key; `more` is a list of longs for
    choose(scores, same_label, own_id, more), which gives a list of (row, column) by slot.
    """
    shared = rings.index.sparkSession.sparkContext.broadcast(rings.space)
    listed = wanted.groupBy(F.col("set").alias("_set")).agg(F.array_sort(F.collect_list(F.struct("at", "threshold", "more"))).alias("asked"))  # at most SET_ROWS of a set
    asked = materialise(rings.sets.join(listed, F.col("set") == F.col("_set")).drop("_set"), "asked")

    def intervals(batches):
        for batch in batches:
            out = []
            for key, data, pivots, keys, asked in zip(*(c.to_pylist() for c in batch.columns)):
                space, at = shared.value, [a["at"] for a in asked]
                rows = pickle.loads(data)[at]
                least = np.array([np.nan if a["threshold"] is None else a["threshold"] for a in asked])
                centre = space.distances(rows, np.zeros(len(rows)))
                with np.errstate(invalid="ignore"):
                    radius = np.sqrt(np.maximum((rows.astype(np.float64) ** 2).sum(1) + space.length2 - 2 * least, 0))
                slack = SLACK * np.sqrt(space.length2)
                low, high = centre - radius[:, None] - slack, centre + radius[:, None] + slack
                own = np.isnan(least)
                low[own], high[own] = np.inf, -np.inf
                place, away = np.frombuffer(pivots, "<i4")[at][own], np.frombuffer(keys, "<f8")[at][own]
                low[np.flatnonzero(own), place], high[np.flatnonzero(own), place] = away, away
                out += [(key, p, a, b) for p, (a, b) in enumerate(zip(low.min(0), high.max(0))) if a <= b]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=["set", "pivot", "low", "high"])

    ring = asked.select("set", "data", "pivots", "keys", "asked").mapInArrow(intervals, _RING)
    meta = rings.index.select("block", F.col("pivot").alias("of"), F.col("low").alias("first"), F.col("high").alias("last"))
    meta = F.broadcast(meta) if rings.blocks <= FEW_BLOCKS else meta
    visits = ring.join(meta, (F.col("pivot") == F.col("of")) & (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))).select(F.col("set").alias("_set"), F.col("block").alias("_block"))
    queries = asked.select("set", F.col("ids").alias("query_ids"), F.col("labels").alias("query_labels"), F.col("data").alias("queries"), "asked")
    pairs = visits.hint("merge").join(queries, F.col("_set") == F.col("set")).drop("_set").hint("merge").join(rings.index, F.col("_block") == F.col("block"))

    def meet(batches):
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in range(5)]
            for key, query_ids, query_labels, queries, asked, ids, labels, data in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.array([a["at"] for a in asked])
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")[at]
                _, codes = np.unique(np.array([*labels, *(query_labels[a] for a in at)]), return_inverse=True)
                scores = products(pickle.loads(queries)[at], pickle.loads(data))
                same = codes[None, : len(ids)] == codes[len(ids) :, None]
                for slot, (row, column) in enumerate(choose(scores, same, ids[None, :] == query_ids[:, None], [a["more"] for a in asked])):
                    if len(row):
                        found = np.array([int(x) for x in scores[row, column]], np.int64)  # fails where one leaves a long
                        for into, x in zip(out, (np.full(len(row), key), at[row], np.full(len(row), slot), ids[column], found)):
                            into.append(x)
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["set", "at", "slot", "id", "score"])

    return pairs.select("set", "query_ids", "query_labels", "queries", "asked", "ids", "labels", "data").mapInArrow(meet, _HIT)
