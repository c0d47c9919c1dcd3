"""Replicates without copies of rows: bootstrap weights, permutations and subsamples inside tasks.

Rows are packed into cells, one binary value each, once. A task draws all replicates of its cells
with NumPy and returns one short vector of sums for each replicate; vectors are added in a tree.
Random numbers are hashes of the seed, the replicate and the place of a row in the table's
order, so results do not depend on how rows were dealt out and SQL can repeat them.

A bootstrap of more than one cell first splits each replicate's draws between the cells, by a tree
of binomial numbers, so their total is exactly the number of rows. Every result begins with the value of the
table as it is, which the same arithmetic gives. A permutation is the order of
the rows' keys: to sum groups only the keys at the borders between them are needed, and
those are found by counts of keys that get finer with each pass, without sorting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.order import carried, spread
from concord.sources.shared import cut

#: Rows of a cell, unless that makes more than MOST_CELLS cells.
CELL_ROWS = 8192
MOST_CELLS = 4096
#: Cells of up to so many rows draw place by place; larger ones by multinomial numbers.
HASHED = 1 << 16
#: Rows up to which drawn_sums() holds a value for each and does not look it up.
EXPANDED = 1 << 26
#: Replicates whose sums are one value on their way to the driver.
CHUNK = 128
#: Bins of a pass that narrows a border, and borders times replicates that are sought at once.
BINS = 64
BORDERS = 1 << 14
#: Rows whose keys are counted at once, and parts of the key space that are told apart by a table.
COUNTED = 1 << 16
FIRST_BITS = 12
#: Rows whose joint order every task holds at most, for statistics that are no sums over cells.
ENTRIES = 1 << 20
#: Where there are more: places whose keys a task sorts at once at most, rows whose values it holds, and rows whose doubled ranks are numbers of 32 bits.
SIDE_ROWS = 1 << 24
MOST_ROWS = 1 << 26
NARROW = 1 << 31

# Fixed values of the hash: odd multipliers below 2^31, so that products fit a long in SQL.
GOLDEN = 0x1E3779B9
FIRST = 0x2C1B3C6D
SECOND = 0x297A2D39


def _turned(x: np.ndarray) -> np.ndarray:
    """One round of an array of 32-bit numbers, whose products wrap."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(15))


def mixed(seed: int, *parts: int | np.ndarray) -> np.ndarray:
    """32-bit hash of non-negative integers, of which the last 32 bits count, element by element."""
    h = np.array([seed & 0xFFFFFFFF], np.uint32)
    for p in parts:
        h = _turned(h + np.atleast_1d(np.asarray(p, np.int64)).astype(np.uint32) + np.uint32(GOLDEN))
    return h


def mixed_sql(source: str, seed: int, *parts: str) -> str:
    """DuckDB: the rows of a source with mixed() of some of its columns as `h`."""
    out = f"SELECT *, {seed}::BIGINT AS h FROM ({source})"
    for p in parts:
        for step in (f"(h + {p} + {GOLDEN}) % 4294967296", f"xor(h, h >> 16) * {FIRST} % 4294967296", f"xor(h, h >> 12) * {SECOND} % 4294967296", "xor(h, h >> 15)"):
            out = f"SELECT * REPLACE ({step} AS h) FROM ({out})"
    return f"({out})"


def keys_of(seed: int, b: int, rows: np.ndarray) -> np.ndarray:
    """62-bit keys of rows, by whose order a replicate permutes them."""
    h = mixed(seed, b)
    if len(rows) and rows[-1] >> 32:
        h = np.where(rows >> 32 > 0, mixed(int(h[0]), rows >> 32), h)
    h = _turned(h + rows.astype(np.uint32) + np.uint32(GOLDEN))
    one, two = (_turned(h + np.uint32(k + GOLDEN)) for k in (0, 1))
    return one.astype(np.int64) << 30 | (two >> np.uint32(2))


def keys_sql(source: str, seed: int, replicate: str = "b", place: str = "i") -> str:
    """DuckDB: the rows of a source with keys_of() as `key`."""
    base = mixed_sql(source, seed, replicate, place)
    one = mixed_sql(f"SELECT * RENAME (h AS h0) FROM {base}", 0, "h0")
    two = mixed_sql(f"SELECT * RENAME (h AS h1) FROM {one}", 0, "h0 + 1")
    return f"(SELECT *, h1 * 1073741824 + (h >> 2) AS key FROM {two})"


def added(parts: DataFrame, keys: Sequence[str], branches: int = 16) -> DataFrame:
    """(keys..., data): sums of equally long vectors of doubles, held as bytes in `data`, by a tree of two levels."""
    schema = T.StructType([*(parts.schema[k] for k in keys), T.StructField("data", T.BinaryType())])

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for blob in rows.column("data"):
            x = np.frombuffer(blob.as_buffer())
            total = x.copy() if total is None else np.add(total, x, out=total)
        return pa.table([*(rows.column(k).slice(0, 1) for k in keys), pa.array([total.tobytes()], pa.binary())], names=schema.names)

    first = parts.withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(branches))).groupBy(*keys, "_branch").applyInArrow(add, schema)
    return first.groupBy(*keys).applyInArrow(add, schema)


def _collected(parts: DataFrame, replicates: int, shape: tuple[int, ...]) -> np.ndarray:
    """(replicates, *shape) sums from (chunk, data)."""
    out = np.zeros((replicates, *shape))
    for r in added(parts, ["chunk"]).collect():
        x = np.frombuffer(r.data).reshape(-1, *shape)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] = x
    return out


def _chunks(replicates: int) -> list[tuple[int, range]]:
    return [(c, range(at, min(at + CHUNK, replicates))) for c, at in enumerate(range(0, replicates, CHUNK))]


_STATE = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _states(chunks: Sequence[int], blobs: Sequence[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], names=_STATE.names)


@dataclass(frozen=True)
class Cells:
    """table: (cell, n, values, counts), cells numbered from 0 in the order of their values; sizes: rows of each."""

    table: DataFrame
    sizes: list[int]
    columns: int
    classes: int

    @property
    def n(self) -> int:
        return sum(self.sizes)


def value_cells(df: DataFrame, values: Sequence[str], label: str | None = None) -> Cells:
    """The distinct values of some columns in their order, with the number of rows of each, or of each label 0 and 1.

    Rows that agree are one entry, so a value that a third of all rows share is one entry too.
    """
    kinds = [F.col(label) == 0, F.col(label) == 1] if label else [F.lit(True)]
    per = df.groupBy(*(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values))).agg(F.count("*").alias("_n"), F.array(*(F.sum(k.cast("long")) for k in kinds)).alias("counts"))
    order = [f"v{k}" for k in range(len(values))]
    placed = spread(per, order)
    n = placed.agg(F.sum("_n")).first()[0] or 0
    size = max(CELL_ROWS, -(-n // MOST_CELLS))
    cell = F.floor(F.col("_before") / size)
    rows = carried(placed, order, "_n", "_before").select(cell.cast("int").alias("cell"), F.array(*order).alias("values"), "counts")

    def pack(table: pa.Table) -> pa.Table:
        m, c = (np.array(table.column(x).combine_chunks().flatten()).reshape(table.num_rows, -1) for x in ("values", "counts"))
        at = np.lexsort(m.T[::-1])
        return pa.table([table.column("cell").slice(0, 1), pa.array([int(c.sum())]), pa.array([m[at].astype("<f8").tobytes()]), pa.array([c[at].astype("<i8").tobytes()])], names=["cell", "n", "values", "counts"])

    table = cut(rows.groupBy("cell").applyInArrow(pack, "cell int, n long, values binary, counts binary").repartition(max(1, -(-n // size))))
    found = sorted(table.select("cell", "n").collect())  # at most about MOST_CELLS
    number = {r.cell: k for k, r in enumerate(found)}
    renamed = table if all(c == k for c, k in number.items()) else table.withColumn("cell", F.create_map(*(F.lit(x) for p in number.items() for x in p))[F.col("cell")])
    return Cells(renamed, [r.n for r in found], len(values), len(kinds))


def draws_of(cell: int, sizes: Sequence[int], replicates: int, seed: int) -> np.ndarray:
    """Rows of a cell, then how many of each replicate's draws fall into it: binomial numbers down a tree of halves, the same in every task."""
    low, high, m = 0, len(sizes), np.full(replicates, sum(sizes), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = sum(sizes[low:middle]) / sum(sizes[low:high])
        left = np.random.Generator(np.random.PCG64([seed, low, high])).binomial(m, share)
        low, high, m = (low, middle, left) if cell < middle else (middle, high, m - left)
    return np.r_[sizes[cell], m]


def weights(seed: int, b: int, cell: int, m: int, counts: np.ndarray) -> np.ndarray:
    """How often a replicate draws each entry of a cell, of whose rows it draws m; -1 is the table itself."""
    if b < 0:
        return counts
    rows = int(counts.sum())
    if rows > HASHED:
        return np.random.Generator(np.random.PCG64([seed, 1 + b, cell])).multinomial(m, counts / rows)
    place = (mixed(seed, b, cell, np.arange(m)).astype(np.uint64) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)
    if rows != len(counts) or (counts != 1).any():
        place = np.searchsorted(np.cumsum(counts), place, side="right")
    return np.bincount(place, minlength=len(counts))


def drawn_sums(values: np.ndarray, counts: np.ndarray, low: int, total: int, replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates) sums of ascending values, each as often as it counts, then of those that each replicate draws from a single cell of `total` rows, of which these begin at place `low`."""
    ends = np.cumsum(counts)
    rows = int(ends[-1])
    each = np.repeat(values, counts) if rows <= EXPANDED else None
    out = np.zeros(1 + replicates)
    out[0] = counts @ values
    for b in range(replicates):
        for at in range(0, total, HASHED):
            place = (mixed(seed, b, 0, np.arange(at, min(at + HASHED, total))).astype(np.uint64) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
            if rows < total:
                place = place[(place >= low) & (place < low + rows)] - low
            out[1 + b] += (each[place] if each is not None else values[np.searchsorted(ends, place, side="right")]).sum()
    return out


def drawn_sql(rows: str, order: str, replicates: int, seed: int) -> str:
    """DuckDB: (b, k): places, in an order of the rows, that the replicates of a bootstrap of one cell draw."""
    places = f"SELECT b, i AS j, n FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM ({rows})), unnest(range(0, {replicates})) t(b)"
    return f"(SELECT b, h * n >> 32 AS k FROM {mixed_sql(places, seed, 'b', '0', 'j')})"


def _entries(cells: Cells, values: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(values, "<f8").reshape(-1, cells.columns), np.frombuffer(counts, "<i8").reshape(-1, cells.classes)


def bootstrap_sums(cells: Cells, features: Callable[[np.ndarray], np.ndarray], width: int, replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates, width): sums of features over all rows, then over those that each replicate draws, as many as there are.

    features gives `width` columns for the entries of a cell.
    """
    sizes, columns, classes = cells.sizes, cells.columns, cells.classes

    def run(batches):
        sums = np.zeros((1 + replicates, width))
        for batch in batches:
            for cell, values, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                x = features(np.frombuffer(values, "<f8").reshape(-1, columns))
                n = np.frombuffer(counts, "<i8").reshape(-1, classes).sum(1)
                for b, m in enumerate(draws_of(cell, sizes, replicates, seed)):
                    sums[b] += weights(seed, b - 1, cell, int(m), n) @ x
        chunks = _chunks(1 + replicates)
        yield _states([c for c, _ in chunks], [sums[r.start : r.stop].tobytes() for _, r in chunks])

    return _collected(cells.table.select("cell", "values", "counts").mapInArrow(run, _STATE), 1 + replicates, (width,))


def bootstrap_aurocs(cells: Cells, replicates: int, seed: int) -> np.ndarray:
    """Area under the ROC curve of the table and of each replicate, NaN with a single class; the cells hold scores by label.

    A cell gives its positives, its negatives and the pairs that it orders right; pairs from different
    cells follow from the order of the cells.
    """
    sizes, columns, classes = cells.sizes, cells.columns, cells.classes

    def run(batches):
        for batch in batches:
            for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(counts, "<i8")
                out = np.zeros((1 + replicates, 3))
                for b, m in enumerate(draws_of(cell, sizes, replicates, seed)):
                    w = weights(seed, b - 1, cell, int(m), n).reshape(-1, classes).astype(np.float64)
                    below = np.cumsum(w[:, 0]) - w[:, 0] / 2
                    out[b] = w[:, 1].sum(), w[:, 0].sum(), w[:, 1] @ below
                for c, r in _chunks(1 + replicates):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([cell], pa.int32()), pa.array([out[r.start : r.stop].tobytes()])], names=["chunk", "cell", "data"])

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        x = np.stack([np.frombuffer(d.as_buffer()).reshape(-1, 3) for d in table.column("data")])
        before = np.cumsum(x[:, :, 1], 0) - x[:, :, 1]
        p, q = x[:, :, 0].sum(0), x[:, :, 1].sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = (x[:, :, 2] + x[:, :, 0] * before).sum(0) / (p * q)
        return pa.table([table.column("chunk").slice(0, 1), pa.array([value.tobytes()])], names=_STATE.names)

    parts = cells.table.select("cell", "counts").mapInArrow(run, "chunk int, cell int, data binary")
    return _collected(parts.groupBy("chunk").applyInArrow(combine, _STATE), 1 + replicates, ())


def by_replicate(df: DataFrame, replicates: int, statistic: Callable[[int], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """(1 + replicates, *shape) of a function of the replicate, from -1, chunks in tasks."""
    spark = df.sparkSession
    chunks = _chunks(1 + replicates)
    tasks = spark.range(len(chunks)).repartitionByRange(len(chunks), "id")

    def run(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                yield _states([c], [np.concatenate([np.ravel(statistic(b - 1)) for b in chunks[c][1]]).astype(np.float64).tobytes()])

    return _collected(tasks.mapInArrow(run, _STATE), 1 + replicates, shape)


def bootstrap_rank_correlations(cells: Cells, replicates: int, seed: int) -> np.ndarray:
    """Rank correlation of two columns over all rows, then over those that each replicate draws, NaN where one does not vary.

    Every task holds the entries of all cells, of which there may be ENTRIES at most.
    """
    rows = sorted(cells.table.select("cell", "values", "counts").collect(), key=lambda r: r.cell)
    if not rows:
        return np.full(1 + replicates, np.nan)
    parts = [_entries(cells, r["values"], r["counts"]) for r in rows]
    codes = [np.unique(np.concatenate([v[:, k] for v, _ in parts]), return_inverse=True)[1] for k in (0, 1)]
    drawn = [draws_of(cell, cells.sizes, replicates, seed) for cell in range(len(cells.sizes))]
    shared = cells.table.sparkSession.sparkContext.broadcast((codes, [c.sum(1) for _, c in parts], drawn))

    def statistic(b: int) -> float:
        codes, counts, drawn = shared.value
        w = np.concatenate([weights(seed, b, cell, int(m[b + 1]), n) for cell, (n, m) in enumerate(zip(counts, drawn))]).astype(np.float64)
        ranks = []
        for code in codes:
            total = np.bincount(code, weights=w)
            ranks.append((np.cumsum(total) - total + (total + 1) / 2)[code])
        x, y = (r - w @ r / w.sum() for r in ranks)
        scale = (w @ (x * x)) * (w @ (y * y))
        return w @ (x * y) / np.sqrt(scale) if scale > 0 else np.nan

    return by_replicate(cells.table, replicates, statistic, ())


@dataclass(frozen=True)
class Places:
    """table: (first, data) of consecutive rows of a table in an order, with the place of the first; n rows of `columns` values."""

    table: DataFrame
    n: int
    columns: int


def placed_rows(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> Places:
    """Rows packed in their order. A value is a number or an array of numbers, all of one length."""
    kinds = dict(df.dtypes)
    parts = [F.col(v).cast("array<double>") if kinds[v].startswith("array") else F.array(F.col(v).cast("double")) for v in values]
    placed = spread(df.select(*dict.fromkeys([*order, *values])), order)
    n, columns = placed.agg(F.count("*"), F.max(F.size(F.concat(*parts)))).first()
    rows = carried(placed, order, F.lit(1), "i").select("i", F.concat(*parts).alias("x"))
    size = max(CELL_ROWS, -(-n // MOST_CELLS))

    def pack(table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("i").to_numpy(), kind="stable")
        m = np.array(table.column("x").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        return pa.table([pa.array([table.column("i").to_numpy()[at[0]]], pa.int64()), pa.array([m[at].tobytes()])], names=["first", "data"])

    table = cut(rows.withColumn("cell", F.floor(F.col("i") / size)).groupBy("cell").applyInArrow(pack, "first long, data binary").repartition(max(1, -(-n // size))))
    return Places(table, n, columns or 0)


def border_keys(rows: Places, borders: Sequence[int], replicates: Sequence[int], seed: int) -> np.ndarray:
    """(replicate, border): a key with exactly `border` rows' keys below it.

    Each pass counts keys in BINS bins of a window that holds the border; the bin of the border is the
    next window, until a bin ends exactly there. Windows start around where the border is to be expected.
    """
    n, top = rows.n, 1 << 62
    t = np.array(borders, np.float64)
    half = (8 * np.sqrt(t * (n - t) / n) + 8) / n * top
    low = np.broadcast_to(np.clip(t / n * top - half, 0, top).astype(np.int64), (len(replicates), len(borders))).copy()
    high = np.broadcast_to(np.clip(t / n * top + half, 1, top).astype(np.int64), low.shape)
    width = np.maximum(1, -(-(high - low) // BINS))
    found = np.full(low.shape, -1, np.int64)
    while (found < 0).any():
        counts = _counted(rows, low, width, found < 0, replicates, seed)
        upto = np.cumsum(counts, 2)  # keys below the window, then below the end of each bin
        for r, k in zip(*np.nonzero(found < 0)):
            at = np.searchsorted(upto[r, k], borders[k])
            if at <= BINS and upto[r, k, at] == borders[k]:
                found[r, k] = low[r, k] + at * width[r, k]
            elif at == 0 or at > BINS:  # outside the window
                low[r, k], width[r, k] = 0, top // BINS
            elif width[r, k] == 1:
                raise ValueError("two rows have one key: take another seed")
            else:
                low[r, k], width[r, k] = low[r, k] + (at - 1) * width[r, k], max(1, -(-width[r, k] // BINS))
    return found


def _tasks(rows: Places) -> int:
    """Each task passes on sums of all replicates, so there are no more of them than keep the cores busy."""
    return max(1, min(-(-rows.n // CELL_ROWS), 2 * rows.table.sparkSession.sparkContext.defaultParallelism))


def below(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the 62-bit keys lie below each edge. Only keys in the same part of the key space as an edge are sorted."""
    parts, shift = 1 << FIRST_BITS, 62 - FIRST_BITS
    at = keys >> shift
    upto = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=parts))])
    near = np.zeros(parts + 1, bool)
    of = np.clip(edges >> shift, 0, parts)  # an edge at the top of the key space lies after all parts
    near[of] = True
    mine = np.sort(keys[near[at]])
    return upto[of] + np.searchsorted(mine, edges) - np.searchsorted(mine, of << shift)


def _counted(rows: Places, low: np.ndarray, width: np.ndarray, wanted: np.ndarray, replicates: Sequence[int], seed: int) -> np.ndarray:
    """(replicate, border, BINS + 1): keys below each window, then in each of its bins. Keys follow from the rows' numbers, so no row is read."""
    spark, n, borders = rows.table.sparkSession, rows.n, low.shape[1]
    tasks = _tasks(rows)
    shared = spark.sparkContext.broadcast((low, width, wanted))

    def run(batches):
        low, width, wanted = shared.value
        out = np.zeros((len(replicates), borders, BINS + 1))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                end = n * (t + 1) // tasks
                for first in range(n * t // tasks, end, COUNTED):
                    at = np.arange(first, min(first + COUNTED, end))
                    for r, b in enumerate(replicates):
                        if len(k := np.flatnonzero(wanted[r])):
                            edges = low[r, k, None] + width[r, k, None] * np.arange(BINS + 1)
                            found = below(keys_of(seed, b, at), edges.ravel()).reshape(edges.shape)
                            out[r, k, 0] += found[:, 0]
                            out[r, k, 1:] += np.diff(found, axis=1)
        chunks = _chunks(len(replicates))
        yield _states([c for c, _ in chunks], [out[r.start : r.stop].tobytes() for _, r in chunks])

    parts = spark.range(tasks).repartitionByRange(tasks, "id").mapInArrow(run, _STATE)
    return _collected(parts, len(replicates), (borders, BINS + 1))


def permuted_sums(rows: Places, sizes: Sequence[int], replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates, groups, columns): sums of the groups' values when rows are dealt to groups of these sizes, first in their own order, then in random ones.

    A group may be left out at the end: rows beyond the last size count for none.
    """
    columns, groups = rows.columns, len(sizes)
    ends = [int(e) for e in np.cumsum(sizes)]
    borders = [e for e in ends if 0 < e < rows.n]
    step = max(1, BORDERS // max(1, len(borders)))
    cuts = np.concatenate([border_keys(rows, borders, range(at, min(at + step, replicates)), seed) for at in range(0, replicates, step)]) if borders else np.zeros((replicates, 0), np.int64)
    shared = rows.table.sparkSession.sparkContext.broadcast(cuts)
    number = np.array([int(np.searchsorted(ends, b, side="right")) for b in [0, *borders]])  # the group after each border

    def after(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if len(cuts) <= 4:
            return number[sum((keys >= c for c in cuts), np.zeros(len(keys), np.int8))]
        return number[np.searchsorted(cuts, keys, side="right")]

    def dealt(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """after() by a table of parts of the key space; only keys in a part that holds a border are compared with the borders."""
        if len(cuts) <= 4:
            return after(cuts, keys)
        starts = np.arange(1 << FIRST_BITS, dtype=np.int64) << (62 - FIRST_BITS)
        one, last = np.searchsorted(cuts, starts, side="right"), np.searchsorted(cuts, starts + ((1 << (62 - FIRST_BITS)) - 1), side="right")
        at = keys >> (62 - FIRST_BITS)
        out = number[one][at]
        near = np.flatnonzero((one != last)[at])
        out[near] = number[np.searchsorted(cuts, keys[near], side="right")]
        return out

    def run(batches):
        out = np.zeros((1 + replicates, groups + 1, columns))
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data).reshape(-1, columns)
                at = first + np.arange(len(x))
                for b in range(1 + replicates):
                    group = dealt(shared.value[b - 1], keys_of(seed, b - 1, at)) if b else after(np.array(borders), at)
                    if columns < 8:
                        for c in range(columns):
                            out[b, :, c] += np.bincount(group, weights=x[:, c], minlength=groups + 1)
                    else:
                        out[b] += (group == np.arange(groups + 1)[:, None]).astype(np.float64) @ x
        chunks = _chunks(1 + replicates)
        yield _states([c for c, _ in chunks], [out[r.start : r.stop].tobytes() for _, r in chunks])

    return _collected(rows.table.coalesce(_tasks(rows)).mapInArrow(run, _STATE), 1 + replicates, (groups + 1, columns))[:, :groups]


def _order(seed: int, b: int, n: int) -> np.ndarray:
    return np.arange(n) if b < 0 else np.argsort(keys_of(seed, b, np.arange(n)), kind="stable")


def permuted_products(rows: Places, left: Sequence[int], right: Sequence[int], replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates, left, right): sums of products of some columns with others whose rows are in their own order, then in random ones.

    Every task holds the rows, of which there may be ENTRIES at most.
    """
    if rows.n > ENTRIES:
        raise ValueError(f"{rows.n} rows: products of permuted rows are for at most {ENTRIES}")
    parts = sorted(rows.table.collect(), key=lambda r: r.first)
    x = np.concatenate([np.frombuffer(r.data).reshape(-1, rows.columns) for r in parts]) if parts else np.zeros((0, len(left)))
    shared = rows.table.sparkSession.sparkContext.broadcast((np.ascontiguousarray(x[:, list(left)]), np.ascontiguousarray(x[:, list(right)])))

    def statistic(b: int) -> np.ndarray:
        a, c = shared.value
        return a.T @ c[_order(seed, b, len(a))]

    return by_replicate(rows.table, replicates, statistic, (len(left), len(right)))


def _turned_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    """_turned() without new arrays."""
    for shift, factor in ((16, FIRST), (12, SECOND), (15, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def first_keys(seed: int, b: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first row, first 32 bits of keys_of()) of rows 0 to n, COUNTED at a time; each array is overwritten by the next.

    Up to 2^32 rows these bits alone differ between rows, as a round maps no two numbers to one.
    """
    h, rows = int(mixed(seed, b)[0]), np.arange(min(n, COUNTED), dtype=np.uint32)
    keys, spare = np.empty_like(rows), np.empty_like(rows)
    for first in range(0, n, COUNTED):
        m = min(COUNTED, n - first)
        if n > 1 << 32:
            yield first, (keys_of(seed, b, np.arange(first, first + m)) >> 30).astype(np.uint32)
            continue
        k, t = keys[:m], spare[:m]
        np.add(rows[:m], np.uint32((h + first + GOLDEN) & 0xFFFFFFFF), out=k)
        _turned_in_place(k, t)
        np.add(k, np.uint32(GOLDEN), out=k)
        _turned_in_place(k, t)
        yield first, k


def _of_part(seed: int, b: int, n: int, low: int, high: int, start: int, y: np.ndarray) -> tuple[int, np.ndarray]:
    """How many rows have a first key below `low`, and the values, in the order of their keys, of those that have one from there to `high`.

    y holds the values of rows from `start` on; other rows count as zero. Whole numbers of 32 bits travel through the sort below the first
    key of their row, others wait for the order of the whole keys.
    """
    packed, below, at, ties = y.dtype == np.int32, 0, 0, []
    room = int(n * (high - low) / (1 << 32) + 6 * np.sqrt(n)) + 64
    pairs = np.empty((room if packed else 0, 2), np.uint32)
    values = pairs[:, 0].view(np.int32) if packed else np.zeros(room)
    for first, keys in first_keys(seed, b, n):
        if high - low < 1 << 32:
            below += int(np.count_nonzero(keys < low)) if low else 0
            mine = np.flatnonzero(keys - np.uint32(low) < np.uint32(high - low))
            keys = keys[mine]
        else:
            mine = slice(None)
        end = at + len(keys)
        if end > room:
            raise ValueError("keys are not spread evenly: take another seed")
        c, z = max(first, start), min(first + COUNTED, start + len(y), n)
        if c < z:
            block = y[c - start : z - start]
            if z - c < min(COUNTED, n - first):
                block = np.concatenate([np.zeros(c - first, y.dtype), block, np.zeros(min(first + COUNTED, n) - z, y.dtype)])
            values[at:end] = block[mine]
        else:
            values[at:end] = 0
        if packed:
            pairs[at:end, 1] = keys
        else:
            ties.append(keys_of(seed, b, np.arange(first, min(first + COUNTED, n))[mine]))
        at = end
    if not packed:
        return below, values[:at][np.argsort(np.concatenate(ties), kind="stable")] if ties else values[:0]
    both = pairs.view("<u8")[:at, 0]
    both.sort()
    return below, pairs[:at, 0].view(np.int32)


def _product(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of products in doubles, a few rows at a time."""
    return sum((float(x[at : at + COUNTED].astype(np.float64) @ y[at : at + COUNTED].astype(np.float64)) for at in range(0, len(x), COUNTED)), 0.0)


def permuted_rank_products(rows: Places, replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates) sums of products of the first column with the second one, whose rows are in their own order, then in random ones; for any number of rows.

    Both columns hold centred ranks, of which the double is a whole number. A task has a part of the places, a part of the rows (all of them up to MOST_ROWS)
    and some replicates. No row is copied for a replicate: the task makes the keys of all rows from their numbers, keeps those of its part of
    the key space, sorts them together with the values of its rows, and multiplies. Parts of the places overlap by more than what the number of
    keys below a border varies.
    """
    n, columns, spark = rows.n, rows.columns, rows.table.sparkSession
    parts, blocks, slack, top = max(1, -(-n // SIDE_ROWS)), max(1, -(-n // MOST_ROWS)), int(5 * np.sqrt(n)) + 16, 1 << 32
    kind = np.int32 if n <= NARROW else np.float64
    ends, starts = ([n * q // m for q in range(m + 1)] for m in (parts, blocks))
    held = [(max(0, ends[q] - slack), min(n, ends[q + 1] + slack)) for q in range(parts)]
    shares = min(1 + replicates, -(-spark.sparkContext.defaultParallelism // (parts * blocks)))
    tasks = [(q, r, range(c - 1, replicates, shares)) for q in range(parts) for r in range(blocks) for c in range(shares)]

    def deal(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = (np.frombuffer(data).reshape(-1, columns) * 2).astype(kind)
                for side in (0, 1):
                    for part, (low, high) in enumerate(held if side == 0 else zip(starts, starts[1:])):
                        low, high = max(low, first), min(high, first + len(x))
                        if low < high:
                            own = [t for t, task in enumerate(tasks) if task[side] == part]
                            yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.int32())), pa.array([side], pa.int32()), pa.array([low], pa.int64()), pa.array([x[low - first : high - first, side].tobytes()], pa.binary())], names=["tasks", "side", "first", "data"])

    def multiply(batches):
        sides, task = None, None
        for batch in batches:
            for t, side, first, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if sides is None:
                    task, (q, r, own) = t, tasks[t]
                    (a, until), (c, end) = held[q], starts[r : r + 2]
                    sides = np.zeros(until - a, kind), np.zeros(end - c, kind)
                if t != task:
                    raise ValueError("rows of two tasks met in one partition")
                values = np.frombuffer(blob.as_buffer(), kind)
                at = first - (a, c)[side]
                sides[side][at : at + len(values)] = values
        if sides is None:
            return
        (x, y), sums = sides, np.zeros(1 + replicates)
        for b in own:
            if b < 0:
                low, high = max(ends[q], c), min(ends[q + 1], end)
                if low < high:
                    sums[0] += _product(x[low - a : high - a], y[low - c : high - c])
                continue
            before, moved = _of_part(seed, b, n, top * q // parts, top * (q + 1) // parts, c, y)
            if before < a or before + len(moved) > until:
                raise ValueError("keys are not spread evenly: take another seed")
            sums[1 + b] += _product(x[before - a : before - a + len(moved)], moved)
        chunks = _chunks(1 + replicates)
        yield _states([k for k, _ in chunks], [(sums[z.start : z.stop] / 4).tobytes() for _, z in chunks])

    dealt = rows.table.mapInArrow(deal, "tasks array<int>, side int, first long, data binary").select(F.explode("tasks").alias("task"), "side", "first", "data")
    return _collected(dealt.repartitionById(len(tasks), "task").mapInArrow(multiply, _STATE), 1 + replicates, ())


def permuted_triangles(x: np.ndarray, y: np.ndarray, df: DataFrame, replicates: int, seed: int) -> np.ndarray:
    """(1 + replicates) sums over pairs of the products of two symmetric matrices, the objects of the second in their own order, then in random ones."""
    shared = df.sparkSession.sparkContext.broadcast((x, y))

    def statistic(b: int) -> float:
        one, other = shared.value
        order = _order(seed, b, len(one))
        return float((one * other[np.ix_(order, order)]).sum() / 2)

    return by_replicate(df, replicates, statistic, ())


def at_least(draws: np.ndarray, value: float) -> np.ndarray:
    """Draws that reach a value, but for rounding."""
    return draws >= value - 1e-9 * abs(value)
