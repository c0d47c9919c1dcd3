"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

A record's leaf is the SHA-256 of its bytes. Records in order of offset make ranges, whose digest
covers each record's length and digest; ranges make larger ranges, and a file's tree ends in one
root. Where a range ends is decided by the digest of its last child, about one in FANOUT, and not by
counting: after a lost or an extra record the ranges that follow are the same again, only at
other offsets, but for one at each end of a span of offsets, within which a task orders records. An audit compares the roots of two replicas and descends only into ranges that
the other replica does not have, to the records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import materialise

FANOUT = 16
#: Children that a range has at most, however their digests are; in effect only where records repeat over and over.
LONGEST = 1024
#: Bytes of a file whose records are put in order together; the next level takes FANOUT times as many, and so on.
SPAN = 1 << 26

_RECORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record", T.BinaryType())])
_LENGTH = re.compile(rb"\r\nContent-Length:\s*(\d+)", re.I)


def response_record(url: Column, record_id: Column, body: Column) -> Column:
    """The bytes of a WARC response record; nulls are empty."""
    text = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, text, F.lit("\r\n\r\n")).cast("binary")


def records_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of an uncompressed WARC file; a broken tail is one last record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        found = _LENGTH.search(data, at, end + 2) if end >= 0 else None
        if not data.startswith(b"WARC/", at) or not found:
            yield at, data[at:]
            return
        stop = min(end + 4 + int(found[1]) + 4, len(data))
        yield at, data[at:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record) of WARC files, plain or gzipped by record; offsets of gzipped ones are those of their members.

    A file is read by one task, as WARC files are about a gigabyte at most by custom; above 2 GB Spark refuses it. An empty file has no
    records, a folder without files gives no rows, and files that repeat are told apart by name alone.
    """

    def members(data: bytes) -> Iterator[tuple[int, bytes]]:
        view, at = memoryview(data), 0
        while at < len(view):
            one, first, parts = zlib.decompressobj(31), at, []
            while at < len(view) and not one.eof:
                parts.append(one.decompress(view[at : at + 65536]))
                at = min(at + 65536, len(view))
            at -= len(one.unused_data)
            yield first, b"".join(parts)
            if not one.eof:
                return

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(members(data) if data.startswith(b"\x1f\x8b") else records_of(data))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], names=_RECORD.names)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, _RECORD)


def leaves_of(records: DataFrame) -> DataFrame:
    """(file, offset, length, id, digest) of records (file, offset, record): all that a tree needs of their bytes.

    id is the WARC-Record-ID of the header, which ends at the first blank line however long it is; empty if it
    has none, or if there is no blank line. Null bytes count as none; records that repeat are records of their own.
    """
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1).cast("binary")  # of bytes, whatever they say
    header = F.when(F.octet_length(head) < F.octet_length("record"), F.decode(head, "ISO-8859-1"))
    record_id = F.regexp_extract(header, r"(?i)\nWARC-Record-ID:[ \t]*([^\r\n]*)", 1)
    return records.select(
        F.col("file").cast("string").alias("file"), "offset", F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"),
        F.coalesce(record_id, F.lit("")).alias("id"), F.sha2(F.coalesce("record", F.lit(b"")), 256).alias("digest"),
    )


def laid_out(leaves: DataFrame, place: str) -> DataFrame:
    """Leaves with the offsets that they have when each file's records follow one another in order of `place`.

    Records of a null file are one file; those of one place go in any order; a null length counts as 0.
    """
    before = Window.partitionBy("file").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _ranges(nodes: DataFrame, span: int, fanout: int) -> DataFrame:
    """Nodes with `up`, the number of their range in their file: about one digest in fanout ends one, and so do spans and LONGEST children."""
    nodes = nodes.withColumn("span", F.coalesce(F.floor(F.col("first") / span), F.lit(0)))
    order = Window.partitionBy("side", "file", "span").orderBy("first", "length", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(fanout)) == 0
    nodes = nodes.withColumn("cut", F.coalesce(F.lag(ends).over(order), F.lit(True))).withColumn("n", F.row_number().over(order))
    last = F.max(F.when(F.col("cut"), F.col("n"))).over(so_far)
    nodes = nodes.withColumn("cut", F.col("cut") | ((F.col("n") - last) % LONGEST == 0)).withColumn("up", F.sum(F.col("cut").cast("int")).over(so_far))
    return nodes.withColumn("up", F.shiftleft(F.col("span").cast("long"), 32) + F.col("up")).drop("cut", "n")


def _above(nodes: DataFrame, by: list[str]) -> DataFrame:
    """One node for each group of nodes: the digest covers lengths and digests of its children in order."""
    child = F.struct("first", "length", "digest")
    up = nodes.groupBy("side", "file", *by).agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("first").alias("first"), F.sum("length").alias("length"))
    line = F.transform("c", lambda x: F.concat_ws(":", x["length"].cast("string"), x["digest"]))
    return up.select("side", "file", *by, "first", "length", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("digest"))


def build_trees(leaves: DataFrame, fanout: int = FANOUT, span: int = SPAN) -> list[DataFrame]:
    """The trees of all files of the replicas in leaves (side, file, offset, length, id, digest), from the records to the roots.

    Each level has side, file, node, up, first, length, digest; up is the node of the next level that holds a node.
    All have as many levels as the largest file needs.
    """
    level = leaves.select("side", "file", F.col("offset").alias("first"), "length", "id", "digest", F.lit(None).cast("long").alias("node"))
    levels = [materialise(_ranges(level, span, fanout), "level")]
    rows = lambda df: df.groupBy("side", "file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most = rows(levels[0])
    while most > fanout:
        span *= fanout
        level = _above(levels[-1], ["span", "up"]).withColumnRenamed("up", "node").drop("span")
        levels.append(materialise(_ranges(level, span, fanout), "level"))
        most //= fanout
    levels[-1] = levels[-1].withColumn("up", F.lit(0).cast("long"))
    return [*levels, _above(levels[-1], ["up"]).withColumnRenamed("up", "node")]


def odd_nodes(nodes: DataFrame) -> DataFrame:
    """(side, file, node) of nodes whose digest the two replicas hold a different number of times in a file."""
    on = lambda side: F.count(F.when(F.col("side") == side, 1))
    odd = nodes.groupBy("file", "digest").agg(on("expected").alias("x"), on("found").alias("y")).filter("x <> y").select(F.col("file").alias("_file"), F.col("digest").alias("_digest"))
    return nodes.join(odd, F.col("file").eqNullSafe(F.col("_file")) & (F.col("digest") == F.col("_digest")), "left_semi").select("side", "file", "node")


def compare(levels: list[DataFrame]) -> DataFrame:
    """(file, id, offset, length, status, digest_expected, digest_found) of the records that differ.

    status is corrupt, missing (not in `found`) or extra; offset and length are those of the expected
    record, and of the found one where it is extra. From the roots down, only children of nodes
    that the other replica lacks are compared.
    """
    nodes = levels[-1]
    for level in reversed(levels[:-1]):
        odd = materialise(odd_nodes(nodes), "differing").select(F.col("side").alias("_side"), F.col("file").alias("_file"), F.col("node").alias("_node"))
        nodes = level.join(odd, (F.col("side") == F.col("_side")) & F.col("file").eqNullSafe(F.col("_file")) & (F.col("up") == F.col("_node")), "left_semi")
    key = ["file", "id", "digest"]
    both = nodes.select("side", *key, "first", "length").withColumn("k", F.row_number().over(Window.partitionBy("side", *key).orderBy("first")))
    left = both.withColumn("sides", F.count("*").over(Window.partitionBy(*key, "k"))).filter("sides = 1")
    left = left.withColumn("k", F.row_number().over(Window.partitionBy("side", "file", "id").orderBy("first")))
    pick = lambda side: F.first(F.when(F.col("side") == side, F.struct("first", "length", "digest")), ignorenulls=True)
    paired = left.groupBy("file", "id", "k").agg(pick("expected").alias("x"), pick("found").alias("y"))
    at = F.coalesce("x", "y")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return paired.select("file", "id", at["first"].alias("offset"), at["length"].alias("length"), status.alias("status"), F.col("x.digest").alias("digest_expected"), F.col("y.digest").alias("digest_found"))


def audit_leaves(expected: DataFrame, found: DataFrame, fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """audit() of replicas whose records are hashed already, as leaves_of() gives them."""
    sides = [leaves.select(F.lit(name).alias("side"), "file", "offset", "length", "id", "digest") for name, leaves in (("expected", expected), ("found", found))]
    return compare(build_trees(sides[0].unionByName(sides[1]), fanout, span))


def audit(expected: DataFrame, found: DataFrame, fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """The records in which two replicas (file, offset, record) differ, as compare() tells them.

    Files are matched by name, and a null name by a null name. A record of one id with other bytes
    is corrupt; records without an id are matched in their order among those that differ. A lost
    record is missing and a further one extra, once, wherever it stands in its file; so is
    a record whose id is damaged, once each way. A record with the same bytes at another place is not reported. A null
    record is empty; of records that repeat, as many as the replicas have more or less are
    reported, the last ones; a file that only one replica has is missing or extra record by
    record; two empty replicas do not differ. Other columns do not matter.
    """
    return audit_leaves(leaves_of(expected), leaves_of(found), fanout, span)
