"""Exact top-k inner products on a bit-sliced index of quantised vectors.

The rows are dealt into blocks; a block holds, for every attribute, one bitmap for each binary
digit of its values above the block's smallest. A query writes each of its components in
signed binary digits, so the score of all rows of a block is a sum of shifted slices, or of
complements where a digit is negative. Full adders on bitmaps add them column by column. The
best rows come from the most significant slice of the sum downward; rows that tie at the
boundary are taken in order of their id, which is the order of the bits.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import materialise

SCALE = 256
#: Rows of a block of the index, and queries that meet a block at once.
BLOCK_ROWS = 16384
QUERY_ROWS = 512
#: Sets of queries that meet a block in one task.
TASK_SETS = 16
#: From this size on quantised components are kept as Python's integers, which have no bound.
WIDE = float(1 << 40)

_BLOCK = T.StructType([T.StructField(n, t) for n, t in (("block", T.IntegerType()), ("ids", T.BinaryType()), ("base", T.BinaryType()), ("bits", T.BinaryType()), ("slices", T.BinaryType()))])
_QUERIES = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("query_ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])
_HITS = T.StructType([T.StructField(n, t) for n, t in (("chunk", T.IntegerType()), ("at", T.IntegerType()), ("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()), ("own", T.BooleanType()))])


def usable(vec_id: str, embedding: str) -> Column:
    """True for rows with an id whose vector has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, bad), F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python's integers if one of them is wide."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if (np.abs(scaled) < WIDE).all():
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise ValueError("a component times the scale leaves the double precision numbers")
    return np.array([math.floor(x) for x in scaled.tolist()], object)


def dumped(values: np.ndarray) -> bytes:
    """Integers of any size with their shape, for one value of a table."""
    wide = values.dtype == object
    head = json.dumps([list(values.shape), wide]).encode() + b"\n"
    return head + (json.dumps(values.ravel().tolist()).encode() if wide else values.astype("<i8").tobytes())


def loaded(data: bytes) -> np.ndarray:
    head, _, rest = data.partition(b"\n")
    shape, wide = json.loads(head)
    return (np.array(json.loads(rest), object) if wide else np.frombuffer(rest, "<i8")).reshape(shape)


def _matrix(batches, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, quantised rows) of a task's rows in order of id; shorter vectors end in zeros."""
    ids, parts = [np.empty(0, np.int64)], []
    for batch in batches:
        ids.append(batch.column(0).cast(pa.int64()).to_numpy())
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        values = quantised(lists.flatten().to_numpy(zero_copy_only=False), scale)
        width = int(sizes.max(initial=0))
        rows = np.zeros((len(sizes), width), values.dtype)
        rows[np.arange(width) < sizes[:, None]] = values
        parts.append(rows)
    width = max((p.shape[1] for p in parts), default=0)
    rows = np.concatenate([np.zeros((0, width), np.int64), *(np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts)])
    key = np.concatenate(ids)
    order = np.argsort(key, kind="stable")
    return key[order], rows[order]


def pack_bits(mask: np.ndarray) -> np.ndarray:
    """Bitmap of a mask in 64-bit words."""
    raw = np.packbits(mask, bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view(np.uint64)


def slices_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest value of each attribute, slices of each, their bitmaps from the lowest digit on)."""
    n = len(rows)
    base = rows.min(0) if n and rows.shape[1] else np.zeros(rows.shape[1], np.int64)
    above = rows - base
    bits = np.array([int(m).bit_length() for m in above.max(0)] if n and rows.shape[1] else [0] * rows.shape[1], np.int64)
    maps = [pack_bits((above[:, d] >> b & 1).astype(bool)) for d, k in enumerate(bits) for b in range(k)]
    return base, bits, np.stack(maps) if maps else np.zeros((0, -(-n // 64)), np.uint64)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(place, 1 or -1) of the digits of value, no two of them next to each other."""
    out, place = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((place, digit))
            value -= digit
        value >>= 1
        place += 1
    return out


def summed(vector: np.ndarray, base: np.ndarray, bits: np.ndarray, maps: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of a non-negative sum, constant): their sum is each row's inner product with vector."""
    first = np.r_[0, np.cumsum(bits)]
    width = min(len(vector), len(bits))
    constant = int(sum(int(q) * int(b) for q, b in zip(vector[:width], base[:width])))
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    for d in range(width):
        for place, digit in signed_digits(int(vector[d])):
            into = plus if digit > 0 else minus
            for b in range(bits[d]):
                into.setdefault(place + b, []).append(first[d] + b)
            if digit < 0:  # -x is the complement of x, less one, in every slice
                constant -= ((1 << int(bits[d])) - 1) << place
    columns: dict[int, list[np.ndarray]] = {}
    for place in {*plus, *minus}:
        columns[place] = [maps[plus.get(place, [])], ~maps[minus.get(place, [])]]
    out, place = [], 0
    while columns:
        stack = columns.pop(place, None)
        x = np.concatenate(stack) if stack else np.zeros((0, maps.shape[1]), np.uint64)
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            half = a ^ b
            columns.setdefault(place + 1, []).append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * k :]])
        if len(x) == 2:
            columns.setdefault(place + 1, []).append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(maps.shape[1], np.uint64))
        place += 1
    return out, constant


def largest(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums in `among`, all if fewer; ties at the boundary go to the first rows."""
    sure, open_ = np.zeros_like(among), among
    for s in reversed(slices):
        both = sure | (open_ & s)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = both, open_ & ~s
            if n == k:
                open_ = np.zeros_like(among)
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    found = rows(sure)
    return np.r_[found, rows(open_)[: k - len(found)]]


def sums_at(slices: list[np.ndarray], rows: np.ndarray, constant: int) -> np.ndarray:
    """The sums of some rows as longs; fails where one leaves a long."""
    digits = [(s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) for s in slices]
    if len(slices) < 62 and abs(constant) < 1 << 62:
        return sum((d << place for place, d in enumerate(digits)), np.full(len(rows), constant, np.int64))
    exact = [constant + sum(int(d[i]) << place for place, d in enumerate(digits)) for i in range(len(rows))]
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("an inner product leaves the range of a long")
    return np.array(exact, np.int64)


def build_index(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(one row per block of about block_rows rows, number of blocks). Rows are dealt evenly, whatever their ids.

    Rows that are not usable() are left out, rows that repeat are all kept; an empty table makes no block, or an empty one.
    """
    rows = vectors.filter(usable(vec_id, embedding)).select(vec_id, embedding)
    blocks = max(1, -(-rows.count() // block_rows))

    def run(batches):
        ids, matrix = _matrix(batches, scale)
        base, bits, maps = slices_of(matrix)
        one = ([TaskContext.get().partitionId()], [ids.tobytes()], [dumped(base)], [bits.tobytes()], [maps.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int32(), *[pa.binary()] * 4))], names=_BLOCK.names)

    return materialise(rows.repartition(blocks).mapInArrow(run, _BLOCK), "index"), blocks


def _query_sets(queries: DataFrame, vec_id: str, embedding: str, scale: int, rows: int) -> tuple[DataFrame, int]:
    chosen = queries.filter(usable(vec_id, embedding)).select(vec_id, embedding)
    sets = max(1, -(-chosen.count() // rows))

    def run(batches):
        ids, matrix = _matrix(batches, scale)
        one = ([TaskContext.get().partitionId()], [ids.tobytes()], [dumped(matrix)])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int32(), pa.binary(), pa.binary()))], names=_QUERIES.names)

    return materialise(chosen.repartition(sets).mapInArrow(run, _QUERIES), "queries"), sets


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id.

    Components are quantised to floor(scale * x) in double, and sums are exact whatever their size; a
    score of the result that leaves a long fails the query. A query's own row, which is one row of its id and
    its quantised vector, is no candidate for it; other rows that repeat its id are. Query rows that
    repeat an id are queries of their own. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; a shorter vector counts as ending in zeros.
    An empty table or query set gives no rows; other columns do not matter. The index stays where it
    lies but for one copy for each TASK_SETS sets of queries; sets of queries, which are
    small, are copied to every block, and a block returns k + 1 rows for a query.
    """
    index, blocks = build_index(vectors, vec_id, embedding, scale, block_rows)
    sets, n_sets = _query_sets(queries, vec_id, embedding, scale, query_rows)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    copies = min(n_sets, max(-(-n_sets // TASK_SETS), -(-cores // blocks)))
    left = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    right = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of"), F.pmod("chunk", F.lit(copies)).alias("own_copy"))
    tasks = blocks * copies
    # merged, not hashed: a task sorts its blocks and sets, on disk where they are many
    pairs = left.repartition(tasks, "block", "copy").hint("merge").join(right.repartition(tasks, "of", "own_copy"), (F.col("block") == F.col("of")) & (F.col("copy") == F.col("own_copy")))

    def run(batches):
        for batch in batches:
            out = []
            for ids, base, bits, raw, chunk, query_ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids, bits, base = np.frombuffer(ids, np.int64), np.frombuffer(bits, np.int64), loaded(base)
                maps = np.frombuffer(raw, np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64))
                every, first = pack_bits(np.ones(len(ids), bool)), np.r_[0, np.cumsum(bits)]

                def equals(row: int, vector: np.ndarray) -> bool:
                    for d in range(max(len(vector), len(bits))):
                        want, value = int(vector[d]) if d < len(vector) else 0, int(base[d]) if d < len(bits) else 0
                        if d < len(bits):
                            value += sum(int(maps[first[d] + b, row >> 6] >> np.uint64(row & 63) & np.uint64(1)) << b for b in range(bits[d]))
                        if value != want:
                            return False
                    return True

                for i, (q, vector) in enumerate(zip(np.frombuffer(query_ids, np.int64), loaded(vectors))):
                    slices, constant = summed(vector, base, bits, maps)
                    rows = largest(slices, every, k + 1)
                    own = [ids[r] == q and equals(r, vector) for r in rows.tolist()]
                    out.append((chunk, i, np.full(len(rows), q), ids[rows], sums_at(slices, rows, constant), np.array(own, bool)))
            if out:
                sizes = [len(x[2]) for x in out]
                cols = [np.repeat(np.array([x[j] for x in out], np.int32), sizes) for j in (0, 1)] + [np.concatenate([x[j] for x in out]) for j in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_HITS.names)

    hits = pairs.select("ids", "base", "bits", "slices", "chunk", "query_ids", "vectors").mapInArrow(run, _HITS)
    order = [F.desc("score"), "vec_id", F.desc("own")]
    place = F.row_number().over(Window.partitionBy("query_id", "chunk", "at").orderBy(*order))
    best = hits.withColumn("place", place).filter(F.col("place") <= k + 1)
    query = Window.partitionBy("query_id", "chunk", "at").orderBy("place")
    seen = F.sum(F.col("own").cast("int")).over(query.rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("seen", seen).filter(~(F.col("own") & (F.col("seen") == 1)))
    rank = F.col("place") - F.when(F.col("seen") > 0, 1).otherwise(0)
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
