"""Benchmark decontamination by Wu-Manber search over words.

Every benchmark item gives windows of WINDOW words (one shorter window if the item is shorter).
Windows of one length form a searcher: a shift table over blocks of two words says how far the
search may jump, suffix buckets select the windows that end in the block at hand, their first
block selects further, and a direct comparison confirms.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import held, map_batches, materialise, named, numbered

WINDOW = 10
#: Bytes of windows in one broadcast table; a larger benchmark is searched for in several passes.
MAX_BYTES = 16 << 20
#: What a window takes besides its words.
WINDOW_BYTES = 64

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
_STATE = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("_hits", T.ArrayType(T.LongType()))]
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII digits, letters and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Searcher:
    """Finds windows of one length in a list of words; windows have numbers."""

    def __init__(self, windows: dict[tuple[bytes, ...], int]):
        self.numbers = windows
        self.m = len(next(iter(windows)))
        self.block = min(2, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for window in windows:
            for end in range(self.block, self.m + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.m - end)
            self.buckets[window[-self.block :]][window[: self.block]].append(window)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(position of the first word, window) for each occurrence."""
        m, size, jump, shift, n = self.m, self.block, self.jump, self.shift.get, len(words)
        end = m
        while end <= n:
            block = tuple(words[end - size : end])
            step = shift(block, jump)
            if step:
                end += step
                continue
            start = end - m
            for window in self.buckets[block].get(tuple(words[start : start + size]), ()):
                if window == tuple(words[start:end]):
                    yield start, window
            end += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (first, last) without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def search(words: list[bytes], searchers: list[Searcher]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges inside occurrences, and the numbers of the windows that occur."""
    spans, numbers = [], set()
    for s in searchers:
        for start, window in s.find(words):
            spans.append((start, start + s.m - 1))
            numbers.add(s.numbers[window])
    return merged(spans), numbers


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(window: its words joined by spaces, items: sorted ids as strings) for each different window."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.StringType())])

    def run(batches):
        for batch in batches:
            items, out = [], []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    out.append(b" ".join(words[i : i + window]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.string())], names=["item", "window"])

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("body"))
    return named.mapInArrow(run, schema).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _searchers(rows: list[tuple[str, int]]) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(dict)
    for window, number in rows:
        words = tuple(window.encode("utf-8", "surrogatepass").split(b" "))
        by_length[len(words)][words] = number
    return [Searcher(w) for w in by_length.values()]


def _pass(docs: DataFrame, text: str, keeps: list[str], table: Broadcast, again: bool) -> DataFrame:
    key = uuid.uuid4().hex

    def make():
        searchers = held(("windows", key), lambda: _searchers(table.value))

        def run(cols):
            counts, spans, hits = [], [], []
            before = zip(cols["spans"].to_pylist(), cols["_hits"].to_pylist()) if again else None
            for body in cols[text]:
                words = words_of(body.as_py())
                found, numbers = search(words, searchers)
                if again:
                    old, known = next(before)
                    found, numbers = merged([*((x["first"], x["last"]) for x in old), *found]), numbers | set(known)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in found])
                hits.append(sorted(numbers))
            return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, _SPANS), "_hits": pa.array(hits, pa.list_(pa.int64()))}

        return run

    return map_batches(docs, make, [text, *(("spans", "_hits") if again else ())], keeps, _STATE)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keeps: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES, items: bool = True
) -> DataFrame:
    """The columns `keeps` of docs with n_words, spans, items, n_hit and contaminated.

    spans are the merged ranges of words (numbers from 0) inside any occurrence of a benchmark
    window, items the sorted ids, as strings, of the items with occurring windows. A null or
    wordless text has no words and no hit; items without words match nothing; a null item id
    reads as the empty string; items or documents that repeat count as they stand, items of
    equal id once. An empty benchmark hits nothing, an empty table gives no rows. Columns of docs with the name of a new one
    are replaced. The window table that is broadcast holds words and numbers of windows, at most about max_bytes;
    a larger benchmark is taken in parts, each searched for in a pass of its own. Which items a window belongs to is joined
    to the documents that hold one, from a table of the kept columns; without `items` that is left out.
    """
    new = ("n_words", "spans", "n_hit", "contaminated", *(["items"] if items else []))
    keeps = [c for c in (keeps if keeps is not None else docs.columns) if c not in new]
    rows, names = numbered(docs, [*keeps, text])
    return named(_found(rows, benchmark, names[text], [names[c] for c in keeps], item_id, item_text, window, max_bytes, items), names, keeps)


def _found(docs: DataFrame, benchmark: DataFrame, text: str, keeps: list[str], item_id: str, item_text: str, window: int, max_bytes: int, items: bool) -> DataFrame:
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, item_id, item_text, window).withColumn("number", F.monotonically_increasing_id()), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + WINDOW_BYTES)).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    found = docs
    for k in range(parts):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).select("window", "number")
        table = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        kept = keeps if k == parts - 1 else list(dict.fromkeys([*keeps, text]))
        found = _pass(found, text, kept, table, again=k > 0)
        if k < parts - 1:
            found = materialise(found, f"part-{k}")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    measured = found.select("*", hit.alias("n_hit"), (F.size("spans") > 0).alias("contaminated"))
    if not items:
        return measured.drop("_hits")
    rows = materialise(measured.withColumn("_row_found", F.monotonically_increasing_id()), "found")
    each = rows.filter("contaminated").select(F.col("_row_found").alias("_of_row"), F.explode("_hits").alias("_number"))
    each = each.join(windows.select(F.col("number").alias("_number"), F.col("items").alias("_items")), "_number")
    whose = each.groupBy("_of_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"))
    out = rows.filter("contaminated").join(whose, F.col("_row_found") == F.col("_of_row"), "left").drop("_row_found", "_of_row", "_hits")
    clean = rows.filter("NOT contaminated").withColumn("items", F.array().cast("array<string>")).drop("_row_found", "_hits")
    return out.unionByName(clean)
