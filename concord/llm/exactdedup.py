"""Exact deduplication on a cuckoo-filter index of live digests.

The index is a table of shards; each holds a cuckoo filter with its keys, SHA-256 digests of
normalised texts, and the number of live documents of each. Documents are inserted and deleted
by digests that are summed up before they move. A filter of the digests that have copies then
tells which texts have to be compared at all: those are dealt into buckets by digest, large
groups into several, and each is compared with the text of its group's first document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import materialise
from concord.llm.cuckoo import DIGEST, CuckooFilter, as_digests, as_keys

WHITE = r"[\x20\x09-\x0D]+"
#: Rows of digests that a shard is meant for.
SHARD_ROWS = 1 << 16
#: Bytes of filters that the driver passes to the tasks at most; beyond it all texts are compared.
FILTER_BYTES = 32 << 20
#: Groups with more than a bucket's documents are at most so many, whose sizes the tasks know.
LARGE_GROUPS = 1 << 16
BUCKET_ROWS = 256

_SHARD = T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("prints", "keys", "digests", "counts"))])
_MOVED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())])


@dataclass(frozen=True)
class Index:
    """shards: one row for each of `n`; members: the live documents, (doc_id, digest)."""

    shards: DataFrame
    n: int
    members: DataFrame


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def members_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest_of(normalised(F.col(f"`{text}`"))).alias("digest"))


def _key(length: int) -> Column:
    """The digest, or for tests of collisions its first bytes."""
    return F.col("digest") if length == DIGEST else F.concat(F.substring("digest", 1, length), F.unhex(F.lit("00" * (DIGEST - length))))


def _summed(members: DataFrame, shards: int) -> DataFrame:
    """(shard, digest, n): the digests of a batch of rows, each once."""

    def run(batches):
        for batch in batches:
            digests = as_digests(b"".join(batch.column(0).to_pylist()))
            keys, n = np.unique(as_keys(digests), return_counts=True)
            own = keys.view(np.uint8).reshape(-1, DIGEST)
            shard = (own[:, 8:16].copy().view("<u8").ravel() % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(n.astype(np.int64))], names=_MOVED.names)

    return members.select("digest").mapInArrow(run, _MOVED)


def _changed(shards: DataFrame, moved: DataFrame, delete: bool) -> DataFrame:
    def change(old: pa.Table, rows: pa.Table) -> pa.Table:
        key = (old if old.num_rows else rows).column("shard")[0].as_py()
        digests, counts = as_digests(b"".join(rows.column("digest").to_pylist())), rows.column("n").to_numpy()
        if old.num_rows:
            live = CuckooFilter.from_row(*(old.column(c)[0].as_py() for c in ("prints", "keys", "digests", "counts")))
        else:
            live = CuckooFilter(len(np.unique(as_keys(digests))) if len(digests) else 0)
        (live.delete if delete else live.insert)(digests, counts)
        return pa.table([pa.array(c, t) for c, t in zip(([key], *([b] for b in live.to_row())), (pa.int32(), *[pa.binary()] * 4))], names=_SHARD.names)

    return shards.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(change, _SHARD)


def build(members: DataFrame, shard_rows: int = SHARD_ROWS) -> Index:
    """An index of members, which is read twice: write it first."""
    spark = members.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, -(-members.count() // shard_rows))
    empty = spark.createDataFrame([], _SHARD)
    return Index(materialise(_changed(empty, _summed(members, n), False), "shards"), n, members)


def insert(index: Index, members: DataFrame) -> Index:
    """The index with further documents; its shards grow as they need to."""
    return Index(materialise(_changed(index.shards, _summed(members, index.n), False), "shards"), index.n, materialise(index.members.unionByName(members), "members"))


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the documents of some ids, all rows of each; ids that it does not have change nothing."""
    gone = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    removed = materialise(index.members.join(gone, same, "left_semi"), "removed")
    shards = materialise(_changed(index.shards, _summed(removed, index.n), True), "shards")
    return Index(shards, index.n, materialise(index.members.join(gone, same, "left_anti"), "members"))


def _with_copies(index: Index) -> DataFrame:
    """(shard, prints): each shard's filter after the digests of single documents are deleted, at the size of what is left."""

    def run(batches):
        for batch in batches:
            out = []
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                live = CuckooFilter.from_row(*row)
                single = live.counts == 1
                live.delete(live.digests[single], live.counts[single])
                live.resize()
                out.append((shard, live.prints.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["shard", "prints"])

    return index.shards.mapInArrow(run, "shard int, prints binary")


def copied(index: Index, most: int = FILTER_BYTES):
    """A function from a digest column to whether it may have copies: false means certainly not.

    Above `most` bytes of filters it says true of every digest.
    """
    filters = materialise(_with_copies(index), "filters")
    size = filters.agg(F.coalesce(F.sum(F.length("prints")), F.lit(0))).first()[0]
    if size > most:
        return lambda digest: F.lit(True)
    n, shared = index.n, index.shards.sparkSession.sparkContext.broadcast({r.shard: r.prints for r in filters.collect()})

    @F.arrow_udf("boolean")
    def may_have(digests: pa.Array) -> pa.Array:
        rows = as_digests(b"".join(digests.to_pylist()))
        shard, out = (rows[:, 8:16].copy().view("<u8").ravel() % np.uint64(n)).astype(np.int64), np.zeros(len(rows), bool)
        for s in np.unique(shard):
            if int(s) in shared.value:
                own, probe = np.flatnonzero(shard == s), CuckooFilter()
                probe.prints = np.frombuffer(shared.value[int(s)], np.uint16).reshape(-1, 4)
                out[own] = probe.may_hold(rows[own])
        return pa.array(out)

    return may_have


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = DIGEST, most: int = FILTER_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: one of each group of equal normalised texts stays.

    A null text is empty; whole texts are compared, so digests that collide do no harm. The row of the
    smallest id stays, ids that are null come last; of rows that repeat that id, one stays. An empty table
    gives no rows, other columns do not matter. docs is read twice and must give the same rows both times.
    Texts without copies stay where they are, but for the few that the filter takes for others.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    members = materialise(rows.select("doc_id", "digest"), "members")
    may_have = copied(build(members.select("doc_id", _key(length).alias("digest"))), most)
    content = materialise(rows.filter(may_have(_key(length))).withColumn("key", _key(length)), "content")
    groups = content.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.min_by("text", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first_text"), F.count("*").alias("group_size"))
    groups = materialise(groups.filter("group_size > 1").withColumnRenamed("key", "group"), "groups")
    limit = max(bucket_rows, -(-members.count() // LARGE_GROUPS))
    parts = F.ceil(F.col("group_size") / limit).cast("int")
    large = groups.filter(F.col("group_size") > limit).select(F.col("group").alias("_of"), parts.alias("_parts"))  # at most LARGE_GROUPS rows
    dealt = content.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(large), F.col("key") == F.col("_of"), "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_row"), F.coalesce("_parts", F.lit(1))).cast("int"))
    firsts = groups.withColumn("_to", F.explode(F.sequence(F.lit(0), parts - 1)))
    compared = dealt.join(firsts.hint("shuffle_hash"), (F.col("key") == F.col("group")) & (F.col("_part") == F.col("_to")), "left")
    other = F.when(F.col("text") != F.col("first_text"), F.col("text"))
    compared = materialise(compared.select("doc_id", "digest", "group", "keep_id", "group_size", other.alias("other")), "compared")
    if not compared.filter("other IS NOT NULL").isEmpty():
        compared = _regrouped(compared)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = members.filter(~may_have(_key(length))).unionByName(compared.filter("group IS NULL").select("doc_id", "digest"))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped, first = compared.filter("group IS NOT NULL"), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stay = grouped.filter(first).groupBy("doc_id", "keep_id", "group_size", "digest").agg(F.count("*").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    stay = stay.select("doc_id", "keep_id", "group_size", (F.col("_i") == 1).alias("kept"), sha)
    go = grouped.filter(~first).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), sha)
    return alone.unionByName(stay).unionByName(go)


def _regrouped(compared: DataFrame) -> DataFrame:
    """The groups of digests that different texts share, by text. None with SHA-256, as far as anyone knows."""
    shared = compared.filter("other IS NOT NULL").select(F.col("group").alias("_shared")).distinct()
    mixed = compared.join(shared, F.col("group") == F.col("_shared"), "left_semi")
    own = mixed.groupBy("group", "other").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size")).withColumnsRenamed({"group": "_of", "other": "_other"})
    exact = mixed.join(own, (F.col("group") == F.col("_of")) & F.col("other").eqNullSafe(F.col("_other")))
    exact = exact.select("doc_id", "digest", "group", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), "other")
    return compared.join(shared, F.col("group") == F.col("_shared"), "left_anti").unionByName(exact)
