"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best fit. Pieces get their place in the order of lengths by counts per task and
a prefix sum over tasks, so no length is ever gathered in one place; from then on equal lengths,
and consecutive sequences with equal gaps, are one row each. Superstep by superstep, from the
longest class of lengths to the shortest:

* the rows of the class and the gaps that may hold them are range-sorted by size, gaps first;
* every partition sweeps from the largest size down and gives each row of pieces its successor,
  the smallest open gap that holds it; where many pieces want the same gaps, the rank of a piece
  decides which gap, and which place in it, is its own;
* what a partition could not match crosses its boundary: pieces without a gap take the smallest
  gaps that the partitions before left, and open new sequences where there are none;
* gaps are updated by what they took, and the next superstep begins.

The result is a table of rank ranges in which every task finds the places of its own pieces.
Every row of it uses up a row of pieces or one of gaps, so the capacity bounds its size whatever
the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import materialise, named, numbered
from concord.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
_RANK_BITS = 40
#: Supersteps end at lengths of which one more than so many fit into a sequence.
CLASSES = (1, 2, 3, 5, 8, 15, 50)
#: Partitions of a superstep.
RANGES = 4
PIECES, GAP, MATCH = 0, 1, 2

_PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]
_LOCAL = [T.StructField("task", T.IntegerType()), T.StructField("task_rank", T.LongType())]
_PLACE = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
_NEW = [f.name for f in (*_PIECE, *_LOCAL, *_PLACE)]


def tokenised_pieces(docs: DataFrame, text: str, keeps: list[str], capacity: int, tokenizer: str) -> DataFrame:
    """Pieces of at most capacity ids with their rank among the task's pieces of the same length."""
    schema = T.StructType([*(docs.schema[c] for c in keeps), *_PIECE, *_LOCAL])

    def run(batches):
        encode, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        task, seen, width = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 4 * capacity
        for batch in batches:
            rows, found = [], []
            for i, body in enumerate(batch.column(0)):
                ids = encode(body.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    rows.append(i)
                    found.append((k, at // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            cols = np.array(found, np.int64).reshape(-1, 5)
            own = [batch.column(j + 1).take(pa.array(rows, pa.int64())) for j in range(len(keeps))]
            new = [pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j].copy()) for j in (1, 2, 3)), pa.array(np.full(len(rows), task, np.int32)), pa.array(cols[:, 4].copy())]
            yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

    return docs.select(F.col(f"`{text}`").alias("_text"), *(docs[f"`{c}`"] for c in keeps)).mapInArrow(run, schema)


# kind PIECES: size is their length, first their first rank, count how many; kind GAP: size is what is free, first the first
# sequence; kind MATCH: size is the length, first the first rank, count the pieces of one sequence, to the first sequence, from its gap
_RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("part", "at", "kind", "open")] + [T.StructField(n, T.LongType()) for n in ("size", "first", "count", "to", "gap")])
_ROW = tuple[int, int, int, int, int, int, int]


class Sweep:
    """Sweep from the largest size down: pieces take the smallest open gaps, and what is left of these.

    It opens sequences, numbered from `number`, for pieces that no gap holds; without a number it passes them on.
    """

    def __init__(self, capacity: int, number: int | None = None):
        self.capacity, self.number = capacity, number
        self.gaps: list[tuple[int, int, int]] = []  # the smallest last
        self.out: list[_ROW] = []

    def pieces(self, length: int, rank: int, n: int) -> None:
        while n:
            if self.gaps:
                gap, first, count = self.gaps.pop()
            elif self.number is None:
                self.out.append((PIECES, 1, length, rank, n, 0, 0))
                return
            else:
                gap, first, count = self.capacity, self.number, -(-n // (self.capacity // length))
                self.number += count
            per = gap // length
            full = min(count, n // per)
            part = n - full * per if full < count else 0
            self.out.append((MATCH, 0, length, rank, per, first, gap))
            if full and gap > per * length:
                self.out.append((GAP, 0, gap - per * length, first, full, 0, 0))
            used = full + (part > 0)
            if used < count:
                self.gaps.append((gap, first + used, count - used))
            if part:
                rest = (gap - part * length, first + full, 1)
                if rest[0] >= length:
                    self.gaps.append(rest)
                elif rest[0]:
                    self.out.append((GAP, 0, *rest, 0, 0))
            rank += full * per + part
            n -= full * per + part

    def rows(self) -> list[_ROW]:
        """What came out in its order, then the gaps that are still open, the smallest last."""
        return [*self.out, *((GAP, 1, *g, 0, 0) for g in self.gaps)]


def _swept(batches: Iterator[pa.RecordBatch], part: int, sweep: Sweep) -> Iterator[pa.RecordBatch]:
    """Rows that are open take part in the sweep, all others pass."""
    for batch in batches:
        for kind, is_open, *run in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_open:
                sweep.out.append((kind, 0, *run))
            elif kind == GAP:
                sweep.gaps.append(tuple(run[:3]))
            else:
                sweep.pieces(*run[:3])
    rows = sweep.rows()
    cols = [[part] * len(rows), range(len(rows)), *(zip(*rows) if rows else [[]] * 7)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j < 4 else pa.int64()) for j, c in enumerate(cols)], names=_RUN.names)


def superstep(runs: DataFrame, capacity: int, least: int, most: int, number: int) -> DataFrame:
    """The rows after all pieces longer than least and up to most have found their places; new sequences are numbered from `number`."""
    size, cols = F.col("size"), _RUN.names[2:]
    is_open = ((F.col("kind") == PIECES) & (size > least) & (size <= most)) | ((F.col("kind") == GAP) & (size > least))
    range_ = F.when(is_open, F.floor((most - F.least(size, F.lit(most))) * RANGES / (most - least))).otherwise(F.pmod(size, F.lit(RANGES))).cast("int")
    ranged = runs.withColumn("open", is_open.cast("int")).repartitionById(RANGES, range_).sortWithinPartitions(F.desc("size"), F.desc("kind"), "first")
    within = ranged.select(cols).mapInArrow(lambda batches: _swept(batches, TaskContext.get().partitionId(), Sweep(capacity)), _RUN)
    joined = within.repartition(1).sortWithinPartitions("part", "at")  # rows of runs, which the capacity bounds
    return joined.select(cols).mapInArrow(lambda batches: _swept(batches, 0, Sweep(capacity, number)), _RUN)


def match(lengths: DataFrame, capacity: int) -> DataFrame:
    """(length, rank, per, first, offset): where the pieces of each length go; lengths has (length, n).

    Rank r of a row goes to sequence first + (r - rank) // per, at offset + (r - rank) % per * length.
    A row holds up to the next one of its length.
    """
    zero = F.lit(0).cast("long")
    runs = lengths.select(*(F.lit(0).alias(c) for c in ("part", "at")), F.lit(PIECES).alias("kind"), F.lit(0).alias("open"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("count"), zero.alias("to"), zero.alias("gap"))
    ends = sorted({capacity // (k + 1) for k in CLASSES} | {0}, reverse=True)
    for step, (least, most) in enumerate(zip(ends, [capacity, *ends])):
        runs = superstep(runs, capacity, least, most, step << _RANK_BITS)
    return runs.filter(F.col("kind") == MATCH).select(F.col("size").alias("length"), F.col("first").alias("rank"), F.col("count").alias("per"), F.col("to").alias("first"), (F.lit(capacity) - F.col("gap")).alias("offset"))


def pack(docs: DataFrame, text: str = "text", keeps: list[str] | None = None, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the columns `keeps`, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and END_ID; those longer than capacity are cut into pieces of it. A null
    text counts as empty, which is one piece of one id. Rows that repeat are packed each for
    itself; an empty table gives no rows; columns of docs with the name of a new one are left out.
    What the driver hands on to all tasks is the table of match(), some rows for each length at most.
    """
    keeps = [c for c in (keeps if keeps is not None else [c for c in docs.columns if c != text]) if c not in _NEW]
    rows, names = numbered(docs, [*keeps, text])
    return named(_packed(rows, names[text], [names[c] for c in keeps], capacity, tokenizer), names, keeps)


def _packed(docs: DataFrame, text: str, keeps: list[str], capacity: int, tokenizer: str | None) -> DataFrame:
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, text, keeps, capacity, tokenizer or default_tokenizer()), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("of_length"), F.col("task").alias("of_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = match(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity).toArrow()
    runs = np.stack([c.to_numpy() for c in rows.columns], 1) if rows.num_rows else np.zeros((0, 5), np.int64)
    table = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    ranked = pieces.join(bases, (pieces["length"] == bases["of_length"]) & (pieces["task"] == bases["of_task"]))
    names = [*keeps, *(f.name for f in _PIECE)]
    ranked = ranked.select(*(pieces[f"`{c}`"] for c in names), (pieces["task_rank"] + bases["base"]).alias("_rank"))
    schema = T.StructType([*(pieces.schema[c] for c in names), *_PLACE])

    def run(batches):
        runs = table.value
        keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column(len(keeps) + 2).to_numpy(), batch.column(len(names)).to_numpy()
            own = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1]
            k = rank - own[:, 1]
            sequence, offset = own[:, 3] + k // own[:, 2], own[:, 4] + k % own[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)
