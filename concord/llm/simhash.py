"""SimHash near-duplicate classes by a segment-popcount embedding.

A fingerprint is embedded as the number of set bits in each of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.
The grid join files each embedding under the cells of its 35 choices of three out of seven
groups of segments: two embeddings within Manhattan distance 4 differ in at most four groups,
so they agree in at least three and share a cell. Members of a cell are compared by the
Manhattan bound first and by the exact Hamming distance then.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import map_batches, materialise, named, numbered
from concord.llm.components import components

SEED = 42
SHINGLE = 4
DISTANCE = 4
GROUPS = 7
SEGMENTS = 32
#: Members of a cell that are compared in one piece; larger cells are dealt out in pairs of pieces.
PIECE = 2048
_BLOCK = 1 << 15
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: -shingle] + 1).tolist()]
    last = ends[shingle - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), _BLOCK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(first)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, keeps: list[str], shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns `keeps` and fp: the fingerprint as a signed long. A null text has fingerprint 0."""

    def make():
        def run(cols):
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in cols[text]), np.uint64, len(cols[text]))
            return {"fp": pa.array(fps.view(np.int64))}

        return run

    return map_batches(docs, make, [text], keeps, [T.StructField("fp", T.LongType())])


def segment_counts(fp: Column) -> Column:
    """Set bits of each two-bit segment, in two bits each."""
    high, even = F.shiftrightunsigned(fp, 1), F.lit(_EVEN)
    one = fp.bitwiseXOR(high).bitwiseAND(even)
    two = fp.bitwiseAND(high).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(two, 1))


def _group_masks(groups: int) -> list[int]:
    bounds = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    keys = [sum(c) for c in combinations(masks, groups - DISTANCE)]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def grid_cells(fps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(cell, fp) for each distinct fp and each of its cells."""
    counts = segment_counts(F.col("fp"))
    keys = F.array(*(F.struct(F.lit(i).alias("plane"), F.col("counts").bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(_group_masks(groups))))
    spread = fps.select("fp", counts.alias("counts")).select("fp", F.explode(keys).alias("key"))
    return spread.select(F.xxhash64("key.plane", "key.at").alias("cell"), "fp")


def near(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Mask of pairs within the distance: the Manhattan bound first, then the exact distance."""
    even = np.uint64(_EVEN)
    one = np.uint64(1)
    ca, cb = a - ((a >> one) & even), b - ((b >> one) & even)
    three, two, four = np.uint64(0x3333333333333333), np.uint64(2), np.uint64(0x4444444444444444)
    bound = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for x, y in ((ca & three, cb & three), ((ca >> two) & three, (cb >> two) & three)):
        d = (x + four) - y  # each nibble holds 4 plus a difference of -2 to 2
        odd = d & np.uint64(0x1111111111111111)
        twos = d & np.uint64(0x2222222222222222) & ~(odd << one)
        bound += (np.bitwise_count(odd) + 2 * np.bitwise_count(twos)).astype(np.uint8)
    mask = bound <= distance
    mask[mask] = np.bitwise_count(np.broadcast_to(a, mask.shape)[mask] ^ np.broadcast_to(b, mask.shape)[mask]) <= distance
    return mask


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Links that connect what the full link graph on fps connects: at most len(fps) - 1 rows of two."""
    left, links = np.unique(fps), []
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            at = front.pop()
            hit = near(at, left, distance)
            if hit.any():
                found = left[hit]
                links.append(np.stack([np.full(found.size, at), found], 1))
                front += list(found)
                left = left[~hit]
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("piece", T.IntegerType())])
_LINKS = T.StructType(_FOUND.fields[:2])
#: Runs up to this length are compared for a whole batch at once.
_SHORT = 8


class _Rows:
    """Collects links and held-over members and turns them into Arrow batches."""

    def __init__(self):
        self.links: list[np.ndarray] = []
        self.members: list[tuple[np.ndarray, int, int]] = []
        self.n = 0

    def link(self, pairs: np.ndarray) -> None:
        if len(pairs):
            self.links.append(pairs)
            self.n += len(pairs)

    def hold(self, fps: np.ndarray, cell: int, piece: int) -> None:
        self.members.append((fps, cell, piece))
        self.n += fps.size

    def take(self, wide: bool) -> pa.RecordBatch:
        pairs = np.concatenate([np.empty((0, 2), np.uint64), *self.links]).view(np.int64)
        a = np.concatenate([pairs[:, 0], *(f.view(np.int64) for f, _, _ in self.members)])
        m = len(a) - len(pairs)
        cols = [pa.array(a), pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(m, pa.int64())])]
        if wide:
            for k, kind in ((1, pa.int64()), (2, pa.int32())):
                held = np.concatenate([np.empty(0, np.int64), *(np.full(x[0].size, x[k]) for x in self.members)])
                cols.append(pa.concat_arrays([pa.nulls(len(pairs), kind), pa.array(held).cast(kind)]))
        self.__init__()
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "cell", "piece"][: len(cols)])


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell in rows sorted by (cell, fp).

    Cells of more than PIECE members are compared piece by piece, and their members come out
    with the number of their piece, to be held against the other pieces.
    """
    rows = _Rows()
    cell, piece, held = None, 0, np.empty(0, np.uint64)

    def close(cell: int, fps: np.ndarray, piece: int) -> None:
        while fps.size:
            part, fps = fps[:PIECE], fps[PIECE:]
            if piece or fps.size:
                rows.hold(part, cell, piece)
            rows.link(spanning_links(part))
            piece += 1

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not fps.size:
            continue
        if cell is not None:
            if keys[0] != cell:
                close(cell, held, piece)
                piece = 0
            else:
                keys, fps = np.concatenate([np.full(held.size, cell), keys]), np.concatenate([held, fps])
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        if piece and len(starts) > 1:  # the rest of a cell begun in an earlier batch
            close(cell, fps[: starts[1]], piece)
            keys, fps = keys[starts[1] :], fps[starts[1] :]
            starts, piece = starts[1:] - starts[1], 0
        cell, held = int(keys[-1]), fps[starts[-1] :]
        while held.size > PIECE:
            rows.hold(held[:PIECE], cell, piece)
            rows.link(spanning_links(held[:PIECE]))
            held, piece = held[PIECE:], piece + 1
        sizes = np.diff(starts)
        short = np.repeat(sizes <= _SHORT, sizes)
        n = short.size
        for d in range(1, min(_SHORT, n)):
            at = np.flatnonzero((keys[: n - d] == keys[d:n]) & short[: n - d])
            if not at.size:
                break
            at = at[near(fps[at], fps[at + d])]
            rows.link(np.stack([fps[at], fps[at + d]], 1))
        for i in np.flatnonzero(sizes > _SHORT):
            close(int(keys[starts[i]]), fps[starts[i] : starts[i + 1]], 0)
        if rows.n > 50_000:
            yield rows.take(True)
    if cell is not None:
        close(cell, held, piece)
    yield rows.take(True)


def _search_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each pair of pieces of one cell; its rows come together and are at most 2 * PIECE."""
    rows = _Rows()
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        fps = batch.column(3).to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if fps.size else []
        for a, b in zip(starts, [*starts[1:], fps.size]):
            if key is not None and (keys[a] != key).any():
                rows.link(spanning_links(np.concatenate(held)))
                held = []
            key = keys[a]
            held.append(fps[a:b])
        if rows.n > 50_000:
            yield rows.take(False)
    if held:
        rows.link(spanning_links(np.concatenate(held)))
    yield rows.take(False)


def links(fps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(a, b) of distinct fingerprints within DISTANCE, enough to connect each class.

    fps holds distinct values in column fp. No pair of a class is emitted twice over from one
    cell: a cell of n members gives at most n - 1 links. Any number of groups above DISTANCE finds
    every link; more groups make more, smaller cells, which pays beyond some 10 ** 8 fingerprints.
    """
    cells = grid_cells(fps, groups).repartition("cell").sortWithinPartitions("cell", "fp")
    found = materialise(cells.mapInArrow(_search_cells, _FOUND), "cells")
    out = found.filter("b IS NOT NULL").select("a", "b")
    large = found.filter("b IS NULL").select(F.col("a").alias("fp"), "cell", "piece")
    if large.isEmpty():
        return out.distinct()
    pieces = large.groupBy("cell").agg((F.max("piece") + 1).alias("pieces"))
    pairs = large.join(pieces, "cell").select("fp", "cell", "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")).filter("piece <> other")
    dealt = pairs.select("cell", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "fp")
    dealt = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "fp")
    return out.union(dealt.mapInArrow(_search_pieces, _LINKS)).distinct()


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keeps: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED, groups: int = GROUPS) -> DataFrame:
    """One row per row of docs: the columns `keeps` (the id alone by default), fp, fingerprint, component_id.

    Texts are lower-cased in A-Z and cut at ASCII white space; fingerprints within DISTANCE bits
    link, and component_id is the smallest id reachable. Null and empty texts have fingerprint 0
    and link like any other; rows that repeat are kept, each with the same class; rows with a null
    id belong to their class, whose component_id is null only if all its ids are. An empty table
    gives an empty result. Columns of docs named fp, fingerprint or component_id are replaced.
    """
    keeps = [c for c in (keeps or [doc_id]) if c not in ("fp", "fingerprint", "component_id")]
    rows, names = numbered(docs, [*keeps, doc_id, text])
    return named(_classes(rows, names[doc_id], names[text], [names[c] for c in keeps], shingle, seed, groups), names, keeps)


def _classes(docs: DataFrame, doc_id: str, text: str, keeps: list[str], shingle: int, seed: int, groups: int) -> DataFrame:
    printed = materialise(with_fingerprint(docs, text, list(dict.fromkeys([*keeps, doc_id])), shingle, seed), "fingerprints")
    reps = materialise(printed.groupBy("fp").agg(F.min(doc_id).alias("first_id")), "distinct")
    roots = components(links(reps.select("fp"), groups))
    member = roots.join(reps, roots["v"] == reps["fp"]).select("fp", "root", "first_id")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classed = member.join(smallest, "root").select("fp", "class_id")
    labels = materialise(reps.join(classed, "fp", "left").select(F.col("fp").alias("label_fp"), F.coalesce("class_id", "first_id").alias("component_id")), "labels")
    out = printed.join(labels, printed["fp"] == labels["label_fp"], "left")
    return out.select(*keeps, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
