"""Dense vectors in array columns: neighbours, Gram matrices, centroids and projections.

A table of vectors has (encoder, case_id, embedding). Work on all pairs of rows goes block by
block: rows are dealt into blocks of a fixed size, and each pair of blocks is one matrix product
in a task. What comes to the driver is d x d, never a matrix of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.sources.shared import cut

#: Rows of a block at most, and components; a product of two blocks takes 32 MB.
BLOCK_ROWS = 2048
BLOCK_VALUES = 1 << 20
#: Vectors of an encoder, first by hash, around which its others are dealt into blocks; one for so many rows.
PIVOTS = 32
ROWS_A_PIVOT = 1024
#: Similarities that agree to so many decimals are equal, as sums of products depend on their order.
DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns; for single rows, not for joins of all pairs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, where a lambda would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def normalised(v: Column) -> Column:
    """The vector in double, divided by its length; a zero vector as it is."""
    divided = lambda u, size: F.transform(u, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))
    return let(v, lambda u: let(F.sqrt(dot(u, u)), lambda size: divided(u, size)))


def sliced(v: Column, first: int, length: int) -> Column:
    """Normalised view of some dimensions, from 1."""
    return normalised(F.slice(v, first, length))


def finite_rows(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite in every component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(embedding).isNotNull() & ~bad)


def last_per_case(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """One vector per case: the last of several."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def _matrix(values: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list array; vectors shorter than the longest, or than width, end in zeros."""
    lists = pa.concat_arrays([values])
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


_BLOCK = T.StructType([T.StructField(n, t) for n, t in (("encoder", T.StringType()), ("block", T.IntegerType()), ("ids", T.BinaryType()), ("width", T.IntegerType()), ("data", T.BinaryType()))])
_EDGES = T.StructType([T.StructField(n, t) for n, t in (("encoder", T.StringType()), ("src", T.LongType()), ("dst", T.LongType()), ("similarity", T.DoubleType()))])


def _near(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vectors with the number of the nearest pivot of their encoder and the distance from it, width of all): what is near in space gets near in order.

    An encoder has PIVOTS pivots at most, its first vectors by hash; an encoder of few rows has one.
    """
    from concord.operators.sampling import hash_key

    sizes = {r.encoder: (r.n, r.w) for r in vectors.groupBy("encoder").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("w")).collect()}  # a panel of encoders
    width = max((w for _, w in sizes.values()), default=0)
    first = F.row_number().over(Window.partitionBy("encoder").orderBy(hash_key("pivot", F.col("case_id")), "case_id", "embedding"))
    table: dict[str, list] = {}
    for r in vectors.select("encoder", "embedding", first.alias("_first")).filter(F.col("_first") <= PIVOTS).orderBy("encoder", "_first").collect():
        if len(table.setdefault(r.encoder, [])) < max(1, sizes[r.encoder][0] // ROWS_A_PIVOT):
            table[r.encoder].append([*r.embedding, *[0.0] * (width - len(r.embedding))])
    shared = vectors.sparkSession.sparkContext.broadcast({e: np.array(v, np.float64) for e, v in table.items()})
    schema = T.StructType([*vectors.schema, T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches):
        for batch in batches:
            names, pivot, away = np.array(batch.column(0).to_pylist()), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for name in np.unique(names):
                own, centres = np.flatnonzero(names == name), shared.value[name]
                rows = _matrix(batch.column(2).take(pa.array(own)), width)
                squares = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
                pivot[own] = squares.argmin(1)
                away[own] = np.sqrt(np.maximum(squares[np.arange(len(own)), pivot[own]], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names=schema.names)

    return vectors.mapInArrow(run, schema), width


def _blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    near, width = _near(vectors)
    rows = max(1, min(rows, BLOCK_VALUES // max(1, width)))
    near = cut(near)
    n = max(1, -(-near.count() // rows))

    def run(batches):
        groups: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            names, ids, pivots = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for name in np.unique(names):
                for pivot in np.unique(pivots[names == name]):
                    own = np.flatnonzero((names == name) & (pivots == pivot))
                    groups.setdefault((name, pivot), []).append((ids[own], _matrix(batch.column(2).take(pa.array(own)), width)))
        for (name, _), parts in groups.items():
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            one = [[str(name)], [TaskContext.get().partitionId()], [ids.astype("<i8").tobytes()], [m.shape[1]], [m.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], names=_BLOCK.names)

    dealt = near.repartitionByRange(n, "encoder", "pivot", "away", "case_id")
    return cut(dealt.select("encoder", "case_id", "embedding", "pivot").mapInArrow(run, _BLOCK)), n


#: Lengths of vectors whose products are first made in single precision, so that none leaves its range.
LENGTHS = 1e-15, 1e15
#: Products of two blocks that are made at a time, so that they stay near the processor, and of which one may be wanted for so many at most.
STRIP_VALUES = 1 << 19
FEW = 32


def _by_row(i: np.ndarray, dst: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Order by row, falling similarity and dst; dst is looked at only if a row has equal similarities."""
    order = np.argsort(-similarity)
    order = order[np.argsort(i[order].astype(np.uint16) if i.max(initial=0) < 1 << 16 else i[order], kind="stable")]  # numbers of 16 bits are dealt, not compared
    alike = (np.diff(i[order]) == 0) & (np.diff(similarity[order]) == 0)
    return np.lexsort((dst, -similarity, i)) if alike.any() else order


class _Best:
    """The k best of each row so far; kth is what a row's next must reach, least what any row's must. They may begin with bounds that k others of each row are known to reach."""

    def __init__(self, rows: int, k: int, bounds: np.ndarray | None = None):
        self.rows, self.k, self.kth, self.waiting = rows, k, np.full(rows, -np.inf) if bounds is None else bounds.copy(), 0
        self.least = float(self.kth.min(initial=np.inf))
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def add(self, i: np.ndarray, dst: np.ndarray, similarity: np.ndarray) -> None:
        """Further edges; those beyond the k best of a row go once there are as many as the rows keep."""
        if len(i):
            self.parts.append((i, dst, similarity))
            self.waiting += len(i)
            if self.waiting >= self.k * self.rows or self.least == -np.inf:
                self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, dst, similarity) of the k best of each row, equal ones by dst."""
        i, d, s = (np.concatenate(c) for c in zip(*self.parts))
        if self.waiting:
            order = _by_row(i, d, np.round(s, DECIMALS))
            i, d, s = i[order], d[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == self.k - 1
            self.kth[i[last]] = np.maximum(self.kth[i[last]], s[last])
            self.least = float(self.kth.min())
            i, d, s = i[place < self.k], d[place < self.k], s[place < self.k]
        self.parts, self.waiting = [(i, d, s)], 0
        return i, d, s


class _Rows:
    """Rows of a block in order of id, in double precision and, where their lengths allow, in single."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m, self.centre = ids, m, m.mean(0)
        self.size, self.radius = float(np.linalg.norm(self.centre)), float(np.sqrt(((m - self.centre) ** 2).sum(1).max(initial=0)))
        self.longest = float(np.sqrt((m * m).sum(1).max(initial=0)))
        self.single = m.astype(np.float32) if LENGTHS[0] <= self.longest <= LENGTHS[1] else None

    def part(self, rows: np.ndarray) -> _Rows:
        """Some of the rows, in order."""
        if len(rows) == len(self.ids):
            return self
        out = object.__new__(_Rows)
        out.ids, out.m, out.longest, out.single = self.ids[rows], self.m[rows], self.longest, None if self.single is None else self.single[rows]
        return out

    def most(self, other: _Rows) -> float:
        """No inner product of rows of the two is larger."""
        return float(self.centre @ other.centre) + self.radius * other.size + other.radius * self.size + self.radius * other.radius


def _strip(*blocks: _Rows) -> np.ndarray:
    """Room for a strip of the products of any two blocks."""
    return np.empty(max([STRIP_VALUES, *(len(b.ids) for b in blocks)]), np.float32)


def _rows_of(table: pa.Table, suffix: str = "") -> list[_Rows]:
    """The blocks of a table."""
    out = []
    for ids, width, data in zip(*(table.column(c + suffix).to_pylist() for c in ("ids", "width", "data"))):
        key = np.frombuffer(ids, "<i8")
        order = np.argsort(key, kind="stable")
        out.append(_Rows(key[order], np.frombuffer(data).reshape(len(key), width)[order]))
    return out


def _products(a: _Rows, b: _Rows) -> np.ndarray:
    """Inner products of the rows of two blocks, in single precision if both have it; -inf is none."""
    if a.single is not None and b.single is not None:
        return a.single @ b.single.T
    exact = a.m @ b.m.T
    if not np.isfinite(exact.sum()):
        exact[~np.isfinite(exact)] = -np.inf
    return exact


def _meet(a: _Rows, b: _Rows, products: np.ndarray, k: int, best_a: _Best | None, best_b: _Best | None) -> None:
    """Adds to the best of a's rows what b's offer, and the other way round; without a best, a side wants nothing.

    What products of single precision leave possible is computed once more in double, so they choose but do not tell. products is changed where a case meets itself.
    """
    low, high = (np.searchsorted(b.ids, a.ids, side) for side in ("left", "right"))
    for i in np.flatnonzero(high > low):
        products[i, low[i] : high[i]] = -np.inf
    slack = _slack(a, b) if products.dtype == np.float32 else 2 * 10.0**-DECIMALS
    for one, other, best, turned in ((a, b, best_a, False), (b, a, best_b, True)):
        if best is None or not len(one.ids) or not len(other.ids):
            continue
        found = _wanted(products, best.kth, k, slack, turned)
        if found is None:  # many are equal
            exact = one.m @ other.m.T
            i, j = nearest(exact, one.ids, other.ids, k, best.kth)
            best.add(i, other.ids[j], exact[i, j])
            continue
        i, j = found
        exact = _inner(one.m, other.m, i, j)
        good = np.isfinite(exact)
        best.add(i[good], other.ids[j[good]], exact[good])


def _meet_settled(x: _Rows, y: _Rows, sides: Sequence[tuple], products: np.ndarray) -> bool:
    """_meet() for all draws of two blocks at once, a strip of products at a time; False, and nothing done, where few products can be told to be too small.

    sides has (rows of x, rows of y, best of the former, best of the latter) for each draw, without a best where nothing is wanted. Rows of a draw have a kth. One comparison with the least
    that a row of x, or any row of y, wants in a draw leaves few products, which each draw then compares with its own. products is where strips of them go.
    """
    if x.single is None or y.single is None or any(b is not None and b.least == -np.inf for *_, one, other in sides for b in (one, other)):
        return False
    slack = _slack(x, y)
    wants, least = np.full(len(x.ids), np.inf), np.inf
    for r, _, one, other in sides:
        if one is not None:
            wants[r] = np.minimum(wants[r], one.kth)
        if other is not None:
            least = min(least, other.least)
    bound = np.nextafter((np.minimum(wants, least) - slack).astype(np.float32), np.float32(-np.inf))
    columns, found, count = len(y.ids), [], 0
    strip = max(1, products.size // max(1, columns))
    reached = np.zeros(-(-min(strip, len(x.ids)) * columns // 8) * 8, bool)
    for at in range(0, len(x.ids), strip):
        own = x.single[at : at + strip]
        some, there = (v[: len(own) * columns].reshape(len(own), columns) for v in (products, reached))
        np.matmul(own, y.single.T, out=some)
        np.greater_equal(some, bound[at : at + strip, None], out=there)
        count += np.count_nonzero(there)
        if count * FEW > (at + len(own)) * columns:
            return False
        reached[there.size :] = False
        eighth = np.flatnonzero(reached.view(np.uint64) != 0)  # eight at a time, as few do
        place, rest = np.nonzero(reached.reshape(-1, 8)[eighth])
        places = eighth[place] * 8 + rest
        found.append((places + at * columns, products[places]))
    places, single = (np.concatenate(c) for c in zip(*found))
    i, j = np.divmod(places, columns)
    chosen, kept = np.zeros(len(i), bool), []
    different = x.ids[i] != y.ids[j]
    for r, c, one, other in sides:
        p, q = _places(r, len(x.ids))[i], _places(c, columns)[j]
        both = different & (p >= 0) & (q >= 0)
        for best, row, ids in ((one, p, y.ids[j]), (other, q, x.ids[i])):
            if best is not None:
                good = np.flatnonzero(both)
                good = good[single[good] >= best.kth[row[good]] - slack]
                chosen[good] = True
                kept.append((best, row, ids, good))
    exact = np.full(len(i), -np.inf)
    exact[chosen] = _inner(x.m, y.m, i[chosen], j[chosen])
    for best, row, ids, good in kept:
        good = good[np.isfinite(exact[good])]
        best.add(row[good], ids[good], exact[good])
    return True


def _bounds(rows: _Rows, k: int) -> np.ndarray:
    """For each row a similarity that k others of these rows reach, or -inf if that is not known."""
    n = len(rows.ids)
    groups = n // max(1, n // (8 * k))
    if rows.single is None or n <= k or groups < k:
        return np.full(n, -np.inf)
    products = rows.single @ rows.single.T
    low, high = (np.searchsorted(rows.ids, rows.ids, side) for side in ("left", "right"))
    for i in range(n):
        products[low[i] : high[i], i] = -np.inf
    tops = products[: n // groups * groups].reshape(-1, groups, n).max(0)  # alike from both sides
    return np.partition(tops, groups - k, axis=0)[groups - k].astype(np.float64) - _slack(rows, rows)


def _places(rows: np.ndarray, n: int) -> np.ndarray:
    """Place of each of n rows among some of them, -1 for none."""
    out = np.full(n, -1)
    out[rows] = np.arange(len(rows))
    return out


def _inner(one: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of one and rows j of the other."""
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", one[i[at : at + 8192]], other[j[at : at + 8192]]) for at in range(0, len(i), 8192))])


def _slack(a: _Rows, b: _Rows) -> float:
    """By how much products of single precision are off at most, with what rounds alike."""
    return (a.m.shape[1] + 4) * 2.0**-23 * a.longest * b.longest + 2 * 10.0**-DECIMALS


def _wanted(products: np.ndarray, kth: np.ndarray, k: int, slack: float, turned: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) that may be among the k best of a row that wants kth at least, or None if too many are alike; turned, rows are the columns of products.

    Rows without a kth begin as in nearest().
    """
    rows, columns = products.shape[::-1] if turned else products.shape
    take = min(k, columns)
    bound = kth - slack
    for narrow in (False, True):
        if narrow or not np.isfinite(kth).all():
            groups = columns // max(1, columns // (8 * take))
            if groups < take:
                tops = products.T if turned else products
            elif turned:
                tops = products[: columns // groups * groups].reshape(-1, groups, rows).max(0).T
            else:
                tops = products[:, : columns // groups * groups].reshape(rows, -1, groups).max(1)
            bound = np.maximum(bound, np.partition(tops, tops.shape[1] - take, axis=1)[:, tops.shape[1] - take].astype(np.float64) - 2 * slack)
        least = np.nextafter(bound.astype(products.dtype), products.dtype.type(-np.inf))
        i, j = _reaching(products, least[None, :] if turned else least[:, None])
        if len(i) <= 8 * take * rows:
            there = products[i, j] > -np.inf
            return (j[there], i[there]) if turned else (i[there], j[there])
    return None


def _grid(blocks: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks (encoder, block, ids, width, ...) as the two sides of cells (encoder, i, j) with i <= j; the second has its columns as <name>2 and none where i = j.

    Products are alike from both sides, so two strips of blocks meet once. A strip has SIDE_VALUES components at most, about, and there are enough cells for all cores: a block is copied once
    for each strip of its encoder, and a row passes on k edges for each.
    """
    sizes = blocks.groupBy("encoder").agg(F.count("*").alias("n"), F.sum(F.length("ids") / 8 * F.col("width")).alias("v")).collect()  # a panel of encoders
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    side = max(-(-int(max((r.v for r in sizes), default=0)) // SIDE_VALUES), int((8 * cores / max(1, len(sizes))) ** 0.5))
    side = max(1, min(side, max((r.n for r in sizes), default=1)))
    n = 4 * max(1, len(sizes)) * side * (side + 1)  # eight for a cell, so that few share a task
    place = F.row_number().over(Window.partitionBy("_e").orderBy("_b")) - 1
    numbers = blocks.select(F.col("encoder").alias("_e"), F.col("block").alias("_b")).distinct().withColumn("strip", F.pmod(place, F.lit(side)))  # a number for each block
    strips = blocks.join(numbers.hint("broadcast"), (F.col("encoder") == F.col("_e")) & (F.col("block") == F.col("_b")))
    left = strips.select("encoder", F.col("strip").alias("i"), F.explode(F.sequence("strip", F.lit(side - 1))).alias("j"), *columns)
    right = strips.filter("strip > 0").select(F.col("encoder").alias("of"), F.explode(F.sequence(F.lit(0), F.col("strip") - 1)).alias("k"), F.col("strip").alias("l"), *(F.col(c).alias(f"{c}2") for c in columns))
    return left.repartition(n, "encoder", "i", "j"), right.repartition(n, "of", "k", "l")


def nearest(exact: np.ndarray, src: np.ndarray, dst: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest similarities, at most; equal ones by their column, and none of a case with itself.

    dst ascends. Similarities below `least` of their row may be left out. The k largest are among those that reach the k-th of the largest of as many
    groups of columns, so all but a few are done with after one comparison. `exact` is changed where a case meets itself.
    """
    rows, columns = exact.shape
    take = min(k, columns)
    if not take or not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if not np.isfinite(exact.sum()):
        exact[~np.isfinite(exact)] = -np.inf
    low, high = (np.searchsorted(dst, src, side) for side in ("left", "right"))
    for i in np.flatnonzero(high > low):
        exact[i, low[i] : high[i]] = -np.inf
    groups = columns // max(1, columns // (8 * take))
    tops = exact[:, : columns // groups * groups].reshape(rows, -1, groups).max(1) if groups >= take else exact
    bound = np.partition(tops, tops.shape[1] - take, axis=1)[:, tops.shape[1] - take]
    bound = (bound if least is None else np.maximum(bound, least)) - 2 * 10.0**-DECIMALS  # what rounds alike counts
    i, j = _reaching(exact, bound[:, None])
    if len(i) > 8 * take * rows:
        return _nearest_of_equals(exact, take)
    i, j = (c[np.isfinite(exact[i, j])] for c in (i, j))
    order = np.lexsort((j, -np.round(exact[i, j], DECIMALS), i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < take], j[place < take]


def _reaching(exact: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column), in this order, where a value reaches the bound of its row or column; eight columns at a time, as few do."""
    rows, columns = exact.shape
    reached = np.zeros((rows, -(-columns // 8) * 8), bool)
    np.greater_equal(exact, bound, out=reached[:, :columns])
    i, eighth = np.nonzero(reached.view(np.uint64))
    at, rest = np.nonzero(reached.reshape(rows, -1, 8)[i, eighth])
    return i[at], eighth[at] * 8 + rest


def _nearest_of_equals(exact: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """nearest() where many similarities are equal, so that they are not sorted; what is not to be chosen is -inf."""
    sim = np.round(exact, DECIMALS)
    least = np.partition(sim, sim.shape[1] - take, axis=1)[:, [sim.shape[1] - take]]
    chosen = sim > least
    ties = sim == least
    room = take - chosen.sum(1)
    plain = ties.sum(1) == room
    chosen[plain] |= ties[plain]
    for i in np.flatnonzero(~plain):
        chosen[i, np.flatnonzero(ties[i])[: room[i]]] = True
    return np.nonzero(chosen & np.isfinite(sim))


def knn_edges(vectors: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(encoder, src, dst, similarity, rank): each row's k nearest by inner product within its encoder.

    A row is not its own neighbour, by id; equal similarities go by ascending id. case_id is a long.
    Rows without an encoder or a case, and those whose vector is absent or holds a null or non-finite component, belong to no graph; a shorter
    vector counts as ending in zeros. Blocks of rows that are near one another meet in the cells of
    a grid, each two once: a block is copied once for each strip of the grid, not to every other block, and a
    cell passes on k edges of a case at most, however many are equal. A cell leaves out the pairs of blocks whose centres
    and radii do not allow a similarity that any row still wants. Products are made in single precision; those that may count are made again in double.
    """
    found = _found_edges(vectors, k, rows).filter("src IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("encoder", "src").orderBy(F.desc(F.round("similarity", DECIMALS)), "dst"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def block_pairs(vectors: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(encoder, pairs, skipped): pairs of blocks that meet in knn_edges(), and those whose product it leaves out."""
    told = _found_edges(vectors, k, rows).filter("src IS NULL")
    return told.groupBy("encoder").agg(F.sum("dst").alias("pairs"), F.sum("similarity").cast("long").alias("skipped"))


def _found_edges(vectors: DataFrame, k: int, rows: int) -> DataFrame:
    """Edges that cells pass on, and for each cell a row without src: its pairs of blocks as dst, those left out as similarity."""
    usable = finite_rows(vectors.filter(F.col("encoder").isNotNull() & F.col("case_id").isNotNull())).select(F.col("encoder").cast("string").alias("encoder"), F.col("case_id").cast("long").alias("case_id"), "embedding")
    blocks, _ = _blocks(cut(usable), rows)
    left, right = _grid(blocks, ["ids", "width", "data"])

    def cell(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        ours = _rows_of(one)
        theirs = ours if same else _rows_of(other, "2")
        best = [[_Best(len(r.ids), k) for r in side] for side in ((ours,) if same else (ours, theirs))]
        strip = _strip(*ours, *theirs)
        pairs = [(a.most(b), p, q) for p, a in enumerate(ours) for q, b in enumerate(theirs) if p <= q or not same]
        skipped = 0
        for most, p, q in sorted(pairs, reverse=True):
            mine, their = best[0][p], best[-1][q]
            # a side whose rows all want more
            wants = [b if b is not None and most >= b.least - 1e-9 * (1 + abs(most)) else None for b in (mine, None if mine is their else their)]
            if wants == [None, None]:
                skipped += 1
                continue
            every = [np.arange(len(rows.ids)) for rows in (ours[p], theirs[q])]
            if not _meet_settled(ours[p], theirs[q], [(*every, *wants)], strip):
                _meet(ours[p], theirs[q], _products(ours[p], theirs[q]), k, *wants)
        out = [(rows.ids[i], d, s) for side, bests in zip((ours, theirs), best) for rows, b in zip(side, bests) for i, d, s in [b.settled()]]
        src, dst, sim = (np.concatenate([np.empty(0, t), *(o[c] for o in out)]) for c, t in enumerate((np.int64, np.int64, np.float64)))
        name = key[0].as_py()
        told = pa.table([pa.array([name], pa.string()), pa.array([None], pa.int64()), pa.array([len(pairs)]), pa.array([float(skipped)])], names=_EDGES.names)
        edges = pa.table([pa.array([name] * len(src), pa.string()), pa.array(src), pa.array(dst), pa.array(sim)], names=_EDGES.names)
        return pa.concat_tables([edges, told])

    return left.groupBy("encoder", "i", "j").cogroup(right.groupBy("of", "k", "l")).applyInArrow(cell, _EDGES)


#: Draws whose numbers the rows of blocks carry at most.
MOST_DRAWS = 4096


def knn_edges_of_draws(vectors: DataFrame, drawn: DataFrame, k: int, draw: str = "draw", rows: int = BLOCK_ROWS) -> DataFrame:
    """(draw, encoder, src, dst, similarity, rank): each row's k nearest among the cases of every draw (case_id, draw) that it is in.

    A block of rows is stored once, with the draws of each row beside it and what its k nearest in a draw reach at least, and holds rows of like draws. Two blocks are multiplied once,
    or draw by draw where that is less, and a cell passes on k edges of a case and draw at most. What knn_edges() says of vectors and of ties holds here.
    """
    drawn = cut(drawn.select("case_id", draw))
    names = [r[0] for r in drawn.filter(F.col(draw).isNotNull()).select(draw).distinct().orderBy(draw).limit(MOST_DRAWS + 1).collect()]
    if len(names) > MOST_DRAWS:
        raise ValueError(f"more than {MOST_DRAWS} draws")
    schema = T.StructType([T.StructField("number", T.IntegerType()), *_EDGES])
    number = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.create_map().cast("map<string,int>")
    numbered = drawn.filter(F.col(draw).isNotNull() & F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("_case")).agg(F.array_sort(F.collect_set(number[F.col(draw)])).alias("draws"))
    usable = finite_rows(vectors.filter(F.col("encoder").isNotNull())).join(numbered, F.col("case_id") == F.col("_case"))
    usable = cut(usable.select(F.col("encoder").cast("string").alias("encoder"), F.col("case_id").cast("long").alias("case_id"), "embedding", "draws"))
    n, width = usable.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // max(1, min(rows, BLOCK_VALUES // max(1, width or 0)))))
    block_schema = T.StructType([*_BLOCK, *(T.StructField(c, T.BinaryType()) for c in ("counts", "draws", "bounds"))])

    def block(batches):
        groups: dict[str, list] = {}
        for batch in batches:
            encoders = np.array(batch.column(0).to_pylist())
            for name in np.unique(encoders):
                own = pa.array(np.flatnonzero(encoders == name))
                lists = pa.concat_arrays([batch.column(3).take(own)])
                groups.setdefault(str(name), []).append((batch.column(1).take(own).to_numpy(), _matrix(batch.column(2).take(own), width), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))
        for name, parts in groups.items():
            ids, m, counts, draws = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(np.repeat(ids, counts), kind="stable")
            lists = np.repeat(np.arange(len(ids)), counts)[order], draws[order]
            bounds = np.empty(len(draws))
            for d in np.unique(draws):
                own = np.flatnonzero(lists[1] == d)
                bounds[order[own]] = _bounds(_Rows(ids[lists[0][own]], m[lists[0][own]]), k)
            binary = (ids.astype("<i8"), counts.astype("<i4"), draws.astype("<i4"), bounds.astype("<f8"))
            one = [[name], [TaskContext.get().partitionId()], [binary[0].tobytes()], [m.shape[1]], [m.tobytes()], *([b.tobytes()] for b in binary[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.string(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4))], names=block_schema.names)

    packed = cut(usable.repartitionByRange(blocks, "encoder", "draws", "case_id").mapInArrow(block, block_schema))
    left, right = _grid(packed, ["ids", "width", "data", "counts", "draws", "bounds"])

    def opened(table: pa.Table, suffix: str = "") -> list:
        """(rows, rows of each draw, best of each draw) of each block."""
        out = []
        for ids, wide, data, counts, draws, bounds in zip(*(table.column(c + suffix).to_pylist() for c in ("ids", "width", "data", "counts", "draws", "bounds"))):
            key, counts, draws, bounds = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4"), np.frombuffer(draws, "<i4"), np.frombuffer(bounds, "<f8")
            order = np.argsort(key, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            row = np.repeat(place, counts)
            at = np.lexsort((row, draws))
            cuts = np.flatnonzero(np.diff(draws[at])) + 1
            parts = {int(draws[a[0]]): a for a in np.split(at, cuts) if len(a)}
            out.append((_Rows(key[order], np.frombuffer(data).reshape(len(key), wide)[order]), {d: row[a] for d, a in parts.items()}, {d: _Best(len(a), k, bounds[a]) for d, a in parts.items()}))
        return out

    def cell(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        ours = opened(one)
        theirs = ours if same else opened(other, "2")
        strip = _strip(*(x for x, _, _ in [*ours, *theirs]))
        for p, (x, mine, best) in enumerate(ours):
            for y, others, bests in theirs[p:] if same else theirs:
                common = sorted(mine.keys() & others.keys())
                # one product for all draws, if it is no more than one for each
                whole = sum(len(mine[d]) * len(others[d]) for d in common) >= len(x.ids) * len(y.ids)
                if whole and _meet_settled(x, y, [(mine[d], others[d], best[d], None if bests is best else bests[d]) for d in common], strip):
                    continue
                whole = _products(x, y) if whole else None
                for d in common:
                    r, c = mine[d], others[d]
                    a, b = x.part(r), y.part(c)
                    products = _products(a, b) if whole is None else whole if a is x and b is y else whole[np.ix_(r, c)]
                    _meet(a, b, products, k, best[d], None if bests is best else bests[d])
        out = [[np.empty(0, t)] for t in (np.int32, np.int64, np.int64, np.float64)]
        for x, members, best in ours if same else [*ours, *theirs]:
            for d, r in members.items():
                i, dst, s = best[d].settled()
                for into, v in zip(out, (np.full(len(i), d, np.int32), x.ids[r][i], dst, s)):
                    into.append(v)
        number, src, dst, sim = map(np.concatenate, out)
        return pa.table([pa.array(number), pa.array([key[0].as_py()] * len(src), pa.string()), pa.array(src), pa.array(dst), pa.array(sim)], names=schema.names)

    found = left.groupBy("encoder", "i", "j").cogroup(right.groupBy("of", "k", "l")).applyInArrow(cell, schema)
    best = F.row_number().over(Window.partitionBy("number", "encoder", "src").orderBy(F.desc(F.round("similarity", DECIMALS)), "dst"))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
    name = F.array(*map(F.lit, names))[F.col("number")] if names else F.lit(None).cast("string")
    return ranked.select(name.alias(draw), "encoder", "src", "dst", "similarity", "rank")


def knn_edges_of_small_draws(vectors: DataFrame, drawn: DataFrame, k: int, draw: str = "draw") -> DataFrame:
    """knn_edges_of_draws() for any number of draws of few cases each: the vectors of a draw and an encoder meet in one task, so the work grows with the draws' rows."""
    members = drawn.filter(F.col(draw).isNotNull() & F.col("case_id").isNotNull()).select(F.col(draw).alias("_draw"), F.col("case_id").alias("_case")).distinct()
    usable = finite_rows(vectors.filter(F.col("encoder").isNotNull())).join(members, F.col("case_id") == F.col("_case"))
    usable = usable.select(F.col("_draw").cast("string").alias("draw"), F.col("encoder").cast("string").alias("encoder"), F.col("case_id").cast("long").alias("case_id"), "embedding")
    schema = T.StructType([T.StructField("draw", T.StringType()), *_EDGES])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("case_id")
        ids, m = table.column("case_id").to_numpy(), _matrix(table.column("embedding").combine_chunks())
        exact = m @ m.T
        i, j = nearest(exact, ids, ids, k)
        same = [pa.array([table.column(c)[0].as_py()] * len(i), pa.string()) for c in ("draw", "encoder")]
        return pa.table([*same, pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(exact[i, j], pa.float64())], names=schema.names)

    found = usable.groupBy("draw", "encoder").applyInArrow(one, schema)
    best = F.row_number().over(Window.partitionBy("draw", "encoder", "src").orderBy(F.desc(F.round("similarity", DECIMALS)), "dst"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).withColumnRenamed("draw", draw)


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(encoder, case_id, neighbours): ids in order of rank; the first k of them are the k-graph."""
    listed = edges.groupBy("encoder", F.col("src").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("n"))
    return listed.select("encoder", "case_id", F.transform("n", lambda x: x["dst"]).alias("neighbours"))


#: Rows of a Gram matrix that travel as one value.
GRAM_ROWS = 64


def grams(vectors: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """Sums over shared cases of the outer products of every two encoders' vectors, each with a last component of 1.

    One pass: each task adds up its cases' products and gives pieces of GRAM_ROWS rows as bytes, which are
    added in a tree, so no cell of a matrix is a row. Row and column sums and the count come from the extra component. A
    case counts for a pair if it has both; of several vectors of a case and encoder one counts. The driver takes pieces one by one and holds the matrices alone.
    """
    from concord.operators.resampling import added

    cases = vectors.groupBy("case_id").agg(F.collect_list(F.struct(F.col("encoder").cast("string").alias("encoder"), F.col("embedding").cast("array<double>").alias("embedding"))).alias("v"))
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            lists = pa.concat_arrays([batch.column(0)])
            case = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            members = lists.flatten()
            names, rows = np.array(members.field("encoder").to_pylist()), members.field("embedding")
            wide = {}
            for name in np.unique(names):
                own, first = np.unique(case[names == name], return_index=True)
                wide[str(name)] = own, np.column_stack([_matrix(rows.take(pa.array(np.flatnonzero(names == name)[first]))), np.ones(len(own))])
            for a, (cases_a, x) in wide.items():
                for b, (cases_b, y) in wide.items():
                    if a <= b:
                        _, i, j = np.intersect1d(cases_a, cases_b, assume_unique=True, return_indices=True)
                        if len(i):
                            g = x[i].T @ y[j]
                            sums[a, b] = sums[a, b] + g if (a, b) in sums else g
        for (a, b), g in sums.items():
            pieces = [g[at : at + GRAM_ROWS] for at in range(0, len(g), GRAM_ROWS)]
            cols = [[a] * len(pieces), [b] * len(pieces), [g.shape[1]] * len(pieces), range(len(pieces)), [p.tobytes() for p in pieces]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=schema.names)

    out, parts = {}, {}
    for r in added(cases.select("v").mapInArrow(run, schema), ["a", "b", "width", "piece"]).toLocalIterator():
        parts.setdefault((r.a, r.b), {})[r.piece] = np.frombuffer(r.data).reshape(-1, r.width)
    for a, b in list(parts):
        pieces = parts.pop((a, b))
        out[a, b] = np.concatenate([pieces[k] for k in sorted(pieces)])
        out[b, a] = out[a, b].T
    return out


def centroids(df: DataFrame, group: str, embedding: str = "embedding", least: int = 1) -> DataFrame:
    """(group, n, centroid): normalised mean vector of every group of enough rows."""
    each = df.filter(F.col(group).isNotNull()).select(group, F.posexplode(embedding).alias("d", "x")).groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = each.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c")).filter(F.col("n") >= least)
    size = F.greatest(F.sqrt(dot(F.col("c"), F.col("c"))), F.lit(1e-9))
    return whole.withColumn("_s", size).select(group, "n", F.transform("c", lambda x: x / F.col("_s")).alias("centroid"))


def centroid_distances(centres: DataFrame, group: str) -> DataFrame:
    """(a, b, distance): cosine distance of every two centroids; groups by groups, not rows."""
    one = centres.select(F.col(group).alias("a"), F.col("centroid").alias("u"))
    other = centres.select(F.col(group).alias("b"), F.col("centroid").alias("v"))
    return one.crossJoin(other).select("a", "b", (1.0 - dot(F.col("u"), F.col("v"))).alias("distance"))


def distance_from(df: DataFrame, centre: DataFrame, embedding: str = "embedding") -> DataFrame:
    """df with its cosine distance from a one-row centroid table."""
    return df.crossJoin(F.broadcast(centre.select(F.col("centroid").alias("_c")))).withColumn("distance", 1.0 - dot(F.col(embedding), F.col("_c"))).drop("_c")  # one row


def relative(vectors: DataFrame, anchors: DataFrame, largest: int = 1 << 15) -> DataFrame:
    """(encoder, case_id, relative): inner products with the anchors of the same encoder, in their order.

    anchors holds (case_id, pos), at most `largest` of them, as the result has a component for each;
    a vector with a NaN gives NaNs. An encoder without any anchor's vector gives empty ones, and rows without a vector
    NULL; where an anchor lacks an encoder's vector, the others keep their order. Shorter vectors count as ending in zeros.
    """
    if anchors.count() > largest:
        raise ValueError(f"more than {largest} anchors make vectors too long")
    chosen = vectors.filter(F.col("embedding").isNotNull()).join(F.broadcast(anchors), "case_id").select("encoder", "pos", "embedding")
    table = {}
    for r in chosen.orderBy("encoder", "pos").collect():
        table.setdefault(r.encoder, []).append(r.embedding)
    width = max((len(x) for v in table.values() for x in v), default=0)
    filled = {k: np.array([[np.nan if c is None else c for c in x] + [0.0] * (width - len(x)) for x in v], np.float64) for k, v in table.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(filled)
    schema = T.StructType([vectors.schema["encoder"], vectors.schema["case_id"], T.StructField("relative", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), [None] * batch.num_rows
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for name in set(names):
                own = np.flatnonzero([n == name and t for n, t in zip(names, there)])
                if name not in shared.value:
                    for i in own:
                        rows[i] = []
                elif len(own):
                    centres = shared.value[name]
                    x = _matrix(batch.column(2).take(pa.array(own)), centres.shape[1])
                    for i, r in zip(own, x[:, : centres.shape[1]] @ centres.T):
                        rows[i] = r
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    return vectors.select("encoder", "case_id", "embedding").mapInArrow(run, schema)


def aligned(manifest: DataFrame, vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """manifest with the vector of its case from one encoder's table, the first of several; null where there is none."""
    one = vectors.groupBy("case_id").agg(F.min(embedding).alias(embedding))
    return manifest.drop(embedding).join(one, "case_id", "left")


#: Components of the vectors that a cell of pairs holds of each side, about, and pairs of a cell.
SIDE_VALUES = 1 << 23
CELL_PAIRS = 1 << 22


def pair_products(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, which, product): inner products of the vectors of x and y for each of the pairs (id, which, encoder, x, y).

    vectors has one vector for each (encoder, case_id). Pairs meet their vectors in the cells of a grid of blocks of cases, so no vector is copied for a pair.
    Pairs without both vectors, and those of vectors of different lengths or with null components, have no row.
    """
    known = vectors.filter(F.col("case_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull()))
    known = cut(known.select("encoder", "case_id", F.col("embedding").cast("array<double>").alias("embedding")))
    most = max((r.v or 0 for r in known.groupBy("encoder").agg(F.sum(F.size("embedding")).alias("v")).collect()), default=0)  # a panel of encoders
    side = max(1, -(-most // SIDE_VALUES))
    salts = max(1, -(-pairs.sparkSession.sparkContext.defaultParallelism // side**2), -(-pairs.count() // (side**2 * CELL_PAIRS)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("encoder", block("x").alias("i"), block("y").alias("j"), F.pmod(F.xxhash64("id", "which"), F.lit(salts)).cast("int").alias("salt"), "id", "which", "x", "y")
    one = known.select("encoder", block("case_id").alias("i"), every(side).alias("j"), "case_id", "embedding")
    other = known.select("encoder", every(side).alias("i"), block("case_id").alias("j"), "case_id", "embedding")
    held = (one if side == 1 else one.unionByName(other.filter("i <> j"))).withColumn("salt", every(salts))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("which", T.StringType()), T.StructField("product", T.DoubleType())])

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        cases = held.column("case_id").combine_chunks()
        at = [pc.index_in(asked.column(c), value_set=cases).to_numpy() for c in "xy"]
        good = np.flatnonzero(~(np.isnan(at[0]) | np.isnan(at[1])))
        i, j = (c[good].astype(np.int64) for c in at)
        lists = pa.concat_arrays(held.column("embedding").chunks) if len(held) else pa.array([], pa.list_(pa.float64()))
        size, x = np.diff(lists.offsets.to_numpy()), _matrix(lists)
        alike = size[i] == size[j]
        good, i, j = good[alike], i[alike], j[alike]
        products = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
        return pa.table([asked.column("id").take(pa.array(good)), asked.column("which").take(pa.array(good)), pa.array(products)], names=schema.names)

    keys = ["encoder", "i", "j", "salt"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(cell, schema)


def _products_of_triplets(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, ab, ac) of rows (id, encoder, a, b, c): the products of a's vector with those of b and c, NULL where there is none."""
    pairs = rows.select("id", "encoder", F.col("a").alias("x"), F.explode(F.create_map(F.lit("ab"), F.col("b"), F.lit("ac"), F.col("c"))).alias("which", "y"))
    found = pair_products(pairs, vectors)
    return found.groupBy("id").agg(*(F.max(F.when(F.col("which") == w, F.col("product"))).alias(w) for w in ("ab", "ac")))


def triplet_choice(triplets: DataFrame, vectors: DataFrame, tie: float = 1e-9) -> DataFrame:
    """triplets (a, b, c, ...) with `nearer`: b or c, whichever is nearer to a; ties and absent vectors drop out. Of several vectors of a case one counts."""
    rows = cut(triplets.withColumn("_id", F.monotonically_increasing_id()))
    one = vectors.groupBy("case_id").agg(F.min("embedding").alias("embedding")).withColumn("encoder", F.lit(""))
    found = _products_of_triplets(rows.select(F.col("_id").alias("id"), F.lit("").alias("encoder"), *"abc"), one)
    out = rows.join(found.hint("shuffle_hash"), F.col("_id") == F.col("id")).withColumn("distance_b", 1.0 - F.col("ab")).withColumn("distance_c", 1.0 - F.col("ac")).drop("_id", "id", "ab", "ac")
    return out.filter(F.abs(F.col("distance_b") - F.col("distance_c")) >= tie).withColumn("nearer", F.when(F.col("distance_b") < F.col("distance_c"), "b").otherwise("c"))


def triplet_strata(triplets: DataFrame, positives: DataFrame, cases: DataFrame) -> DataFrame:
    """triplets (a, b, c, ...) with label_stratum: whether exactly one of b and c shares a positive finding with a.

    positives holds (case_id, finding) of at most 63 findings, cases the case_id of all that labels are known for; a triplet with a case
    that is not among them is labels_unavailable. A case's findings are one bitmap, so two cases share one where both bitmaps have a bit.
    """
    names = [r[0] for r in positives.filter(F.col("finding").isNotNull()).select("finding").distinct().orderBy("finding").limit(64).collect()]
    if len(names) > 63:
        raise ValueError("a bitmap holds 63 findings")
    bit = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)))[F.col("finding")] if names else F.lit(0)
    found = positives.filter(F.col("finding").isNotNull()).groupBy(F.col("case_id").alias("_of")).agg(F.bit_or(bit.cast("long")).alias("_found"))
    maps = cases.select("case_id").distinct().join(found, F.col("case_id") == F.col("_of"), "left").select("case_id", F.coalesce("_found", F.lit(0).cast("long")).alias("_bits"))
    for name in "abc":
        triplets = triplets.join(maps.select(F.col("case_id").alias(f"_{name}"), F.col("_bits").alias(f"_bits_{name}")), F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    shares = [F.bit_count(F.col("_bits_a").bitwiseAND(F.col(f"_bits_{x}"))) > 0 for x in "bc"]
    stratum = F.when(shares[0].isNull() | shares[1].isNull(), "labels_unavailable").when(shares[0] != shares[1], "one_candidate_shares_a_finding").otherwise("ambiguous_by_labels")
    return triplets.withColumn("label_stratum", stratum).drop("_bits_a", "_bits_b", "_bits_c")


def triplet_accuracy(triplets: DataFrame, vectors: DataFrame, kinds: dict[str, str] | None = None, tie: float = 1e-9) -> DataFrame:
    """(encoder, encoder_kind, conditioning, triplet_acc, n_scored, n_tied, n_absent_case, n_triplets) by encoder, over all and by label_stratum.

    A triplet has a, b, c and the choice b or c, in any case; it scores if the nearer of the two is the choice. One with a case that lacks a finite
    vector of the encoder counts as absent, one with equal distances as tied. kinds names the kind of encoders that are not of the
    frozen panel, the consensus say. A stratum without scored triplets has no row.
    """
    rows = triplets.select(*"abc", F.lower(F.trim("choice")).alias("choice"), (F.col("label_stratum") if "label_stratum" in triplets.columns else F.lit("labels_unavailable")).alias("label_stratum"))
    encoders = [r[0] for r in vectors.select("encoder").distinct().orderBy("encoder").collect()]  # a panel
    good = finite_rows(vectors).groupBy("encoder", "case_id").agg(F.min("embedding").alias("embedding"))
    each = rows.withColumn("encoder", F.explode(F.array(*map(F.lit, encoders))) if encoders else F.lit(None).cast("string"))
    each = cut(each.withColumn("id", F.monotonically_increasing_id()))
    found = _products_of_triplets(each.select("id", "encoder", *"abc"), good).withColumnRenamed("id", "_of")
    each = each.join(found.hint("shuffle_hash"), F.col("id") == F.col("_of"), "left").select("encoder", "label_stratum", "choice", (F.col("ab") - F.col("ac")).alias("gap"))
    tied, hit = F.abs("gap") < tie, (F.when(F.col("gap") > 0, "b").otherwise("c") == F.col("choice")).cast("double")
    scored = F.col("gap").isNotNull() & ~tied
    sums = cut(each.groupBy("encoder", "label_stratum").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap").isNull(), 1)).alias("absent"), F.count(F.when(tied, 1)).alias("tied"), F.count(F.when(scored, 1)).alias("scored"), F.sum(F.when(scored, hit)).alias("hits")))
    whole = sums.groupBy("encoder").agg(*(F.sum(c).alias(f"_{c}") for c in ("n", "absent", "tied", "scored", "hits")))
    rest = [F.col("_tied").alias("n_tied"), F.col("_absent").alias("n_absent_case"), F.col("_n").alias("n_triplets")]
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("encoder")], F.lit("frozen_panel")) if kinds else F.lit("frozen_panel")
    out = whole.select("encoder", F.lit("all").alias("conditioning"), (F.col("_hits") / F.col("_scored")).alias("triplet_acc"), F.col("_scored").alias("n_scored"), *rest).filter("n_scored > 0")
    strata = sums.filter("scored > 0").join(whole, "encoder").select("encoder", F.col("label_stratum").alias("conditioning"), (F.col("hits") / F.col("scored")).alias("triplet_acc"), F.col("scored").alias("n_scored"), *rest)
    return out.unionByName(strata).select("encoder", kind.alias("encoder_kind"), "conditioning", "triplet_acc", "n_scored", "n_tied", "n_absent_case", "n_triplets")


def mean_cosine(df: DataFrame, by: list[str], embedding: str = "embedding") -> DataFrame:
    """Mean cosine of two different rows of a group, from the length of the sum of its unit vectors."""
    unit = df.select(*by, F.posexplode(normalised(F.col(embedding))).alias("d", "x"))
    sums = unit.groupBy(*by, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    n = F.max("n").cast("double")
    return sums.groupBy(*by).agg(((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cosine"), F.max("n").alias("n"))


def encoded(df: DataFrame, content: str, encode, keeps: list[str]) -> DataFrame:
    """Vectors of contents (texts, or bytes of files) by a function of a list of them; the hook for outside encoders."""
    schema = T.StructType([*(df.schema[c] for c in keeps), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            vectors = [list(map(float, v)) for v in encode(batch.column(len(keeps)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return df.select(*keeps, content).mapInArrow(run, schema)
