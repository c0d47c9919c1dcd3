"""Token counts of documents in flat token files by a scan for separators.

A flat file is a stream of little-endian ids without an index, each document followed by an
end-of-document id. Spark reads it in byte ranges that pay no heed to documents or ids. Each block
of such a range is searched for the separator at once, in every alignment that its unknown place
in the file allows, and gives its length and the places found. A prefix scan over the blocks
of a file then carries position, document number and the last separator from block to block,
which settles the alignment and stitches ids and documents that lie across blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import materialise
from concord.llm.tokens import default_tokenizer, encoder
from concord.sources.shared import shared_dir

DTYPE = "<u2"
#: The end-of-document id of the default tokenizer.
END_OF_DOCUMENT = 49407
#: Byte at which Spark may end a row while it reads a flat file; the more common, the shorter the rows. It stays part of the data.
ROW_END = 0x0A

_IDS = [T.StructField("_ordinal", T.LongType()), T.StructField("_ids", T.BinaryType())]
_AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_HEX, _OTHER_HEX = "0123456789ABCDEF", "ghijklmnopqrstuv"
_FOUND = T.StructType(
    [T.StructField("file", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("block", "part", "size", "n_bytes"))]
    + [T.StructField("places", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("lasts", T.ArrayType(T.LongType()))]
    + [T.StructField("head", T.BinaryType()), T.StructField("tail", T.BinaryType())]
)
_ARROW = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.list_(pa.int64())), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 2]


def write_flat(docs: DataFrame, text: str, keeps: list[str], tokenizer: str | None = None, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> tuple[str, DataFrame]:
    """(folder of flat files below the shared folder, manifest: the columns `keeps`, of_file, of_ordinal).

    One flat file holds the texts of one task, in order; of_file is its name. Texts are read once: a
    task writes its flat file and, beside it, whose texts they are, so nothing moves between
    executors. Kept columns pass through JSON. Strings of special tokens inside texts are ordinary text, so a text never holds the separator; an id
    that dtype cannot hold fails the job. A null text is empty, texts that repeat are written each
    for itself, and an empty table gives no files and an empty manifest. Kept columns may have any
    names but the two new ones, which replace them. The manifest only tells whose count is whose; the scan does not read it.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    keeps = [c for c in keeps if c not in ("of_file", "of_ordinal")]
    names = [f"_kept_{i}" for i in range(len(keeps))]
    kept = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keeps)])
    schema = T.StructType([*kept, *_IDS])
    if not 0 <= end_id <= np.iinfo(dtype).max:
        raise ValueError("the separator does not fit into dtype")

    def run(batches):
        encode, most, ordinal = encoder(tokenizer, True), np.iinfo(dtype).max, 0
        for batch in batches:
            out = []
            for body in batch.column(len(keeps)):
                ids = np.frombuffer(encode(body.as_py()), "<u4")
                if ids.size and ids.max() > most:
                    raise ValueError("a token id does not fit into dtype")
                if (ids == end_id).any():
                    raise ValueError("a text holds the separator")
                out.append(ids.astype(dtype).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(ordinal, ordinal + n)), pa.array(out, pa.binary())], names=schema.names)
            ordinal += n

    path, end = f"{shared_dir(spark)}/flat", np.array([end_id], dtype).tobytes()
    # Spark's text writer puts out the bytes of a value as they are, and the line separator after each;
    # the manifest is written in digits that do not hold the separator
    digits = _OTHER_HEX if chr(end[0]) in _HEX else _HEX
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for n, c in zip(names, keeps)), docs[f"`{text}`"].alias("_text")).mapInArrow(run, schema)
    whose = F.translate(F.hex(F.to_json(F.struct(*names, "_ordinal"), _AS_JSON)), _HEX, digits)
    both = F.array(F.struct(F.lit("ids").alias("kind"), F.col("_ids").cast("string").alias("value")), F.struct(F.lit("whose").alias("kind"), whose.alias("value")))
    lines = rows.select("_ordinal", F.explode(both).alias("x")).select("_ordinal", "x.*").sortWithinPartitions("kind", "_ordinal").select("value", "kind")
    as_lines = {"encoding": "ISO-8859-1", "lineSep": end.decode("latin-1")}
    lines.write.options(**as_lines, compression="none").partitionBy("kind").text(path)
    if docs.isEmpty():
        written = spark.createDataFrame([], "value string, file string")
        written.select("value").write.text(f"{path}/kind=ids")
    else:
        written = spark.read.options(**as_lines).text(f"{path}/kind=whose").select("value", F.col("_metadata.file_name").alias("file"))
    parsed = F.from_json(F.decode(F.unhex(F.translate("value", digits, _HEX)), "UTF-8"), T.StructType([*kept, _IDS[0]]), _AS_JSON)
    manifest = written.select(parsed.alias("x"), "file").select(*(F.col(f"x.{n}").alias(c) for n, c in zip(names, keeps)), F.col("file").alias("of_file"), F.col("x._ordinal").alias("of_ordinal"))
    return f"{path}/kind=ids", manifest


def read_flat(spark: SparkSession, path: str, row_end: int = ROW_END) -> DataFrame:
    """(file, size, block, data) of flat files on any file system that Spark reads, of any size, in byte ranges.

    file is the path, size its length in bytes, block the first byte of the range. The rows of a range are in order, and
    end at bytes of value row_end, which they keep; the last row of a file has one such byte too many if the file
    does not end in it. Nothing else is changed. Empty files have no rows.
    """
    lines = spark.read.option("lineSep", chr(row_end)).option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    return lines.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.concat(F.col("value").cast("binary"), F.lit(bytes([row_end]))).alias("data"))


def count_tokens(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): one row per document of each file, in order; blocks as read_flat() gives them.

    ordinal counts from 0, start is the place of the first id in the file, n_tokens leaves the
    separator out, and closed is false for ids after the last separator. Two separators in a row
    are an empty document; an empty file or table gives no rows; null data is an empty block.
    Ranges of any and of unequal length will do, and other columns do not matter; files of the same bytes
    count each for itself. Bytes at the end that are no whole id are left out.
    """
    width, end = np.dtype(dtype).itemsize, np.array([end_id], dtype).tobytes()

    def run(batches):
        part: dict[tuple, int] = {}
        for batch in batches:
            files, starts, sizes = (batch.column(c).to_pylist() for c in range(3))
            edges = [i for i in range(batch.num_rows) if i == 0 or starts[i] != starts[i - 1] or files[i] != files[i - 1]] + [batch.num_rows]
            rows = []
            for a, b in zip(edges, edges[1:]):
                data = b"".join(batch.column(3).slice(a, b - a).to_pylist())
                found = []
                for shift in range(width):
                    ids = np.frombuffer(data, dtype, max(0, len(data) - shift) // width, shift) if len(data) > shift else np.empty(0, dtype)
                    found.append(np.flatnonzero(ids == end_id) * width + shift)
                key = (files[a], starts[a])
                part[key] = part.get(key, -1) + 1
                lasts = [int(f[-1]) if len(f) else None for f in found]
                rows.append((*key, part[key], sizes[a], len(data), found, [len(f) for f in found], lasts, data[: width - 1], data[max(0, len(data) - width + 1) :]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_FOUND.names)

    typed = blocks.select("file", F.col("block").cast("long").alias("block"), F.col("size").cast("long").alias("size"), F.coalesce("data", F.lit(b"")).alias("data"))
    found = materialise(typed.mapInArrow(run, _FOUND), "found")
    # what a file's scan carries is a few numbers for each block; the places stay behind
    scan = found.select("file", "block", "part", "size", "n_bytes", "counts", "lasts", "head", "tail")
    order = Window.partitionBy("file").orderBy("block", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = scan.withColumn("at", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    # the last bytes before a block, and its first ones: a separator may lie across
    tail, none = F.lit(b""), F.lit(b"")
    for back in range(1, width):
        tail = F.concat(F.coalesce(F.lag("tail", back).over(order), none), tail)
    scan = scan.withColumn("left", F.substring(tail, F.greatest(F.octet_length(tail) - width + 2, F.lit(1)), F.lit(width - 1)))
    across = F.concat("left", "head")
    begins = [F.when(F.substring(across, k, width) == F.lit(end), F.col("at") - F.octet_length("left") + k - 1) for k in range(1, width)]
    crossing = F.filter(F.array(*begins), lambda x: x.isNotNull() & (x < F.col("at")) & (x + width > F.col("at")) & (x % width == 0))
    scan = scan.withColumn("shift", F.pmod(-F.col("at"), F.lit(width)).cast("int")).withColumn("crossing", F.transform(crossing, lambda x: (x / width).cast("long")))
    scan = scan.withColumn("n_ends", F.size("crossing") + F.col("counts")[F.col("shift")])
    scan = scan.withColumn("last_end", F.coalesce(((F.col("lasts")[F.col("shift")] + F.col("at")) / width).cast("long"), F.element_at(F.col("crossing"), F.when(F.size("crossing") > 0, F.lit(-1)))))
    scan = scan.withColumn("done", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("previous", F.coalesce(F.max("last_end").over(before), F.lit(-1).cast("long")))
    scan = scan.withColumn("is_last", F.lead("block").over(order).isNull())
    n_ids = F.floor(F.col("size") / width)
    rest = F.when(F.col("is_last") & (F.coalesce("last_end", "previous") < n_ids - 1), F.array(n_ids)).otherwise(F.array().cast("array<bigint>"))
    scan = scan.select("file", "block", "part", "at", "shift", "crossing", "n_ends", "done", "previous", rest.alias("rest"))
    places = found.select(F.col("file").alias("of"), F.col("block").alias("of_block"), F.col("part").alias("of_part"), "places")
    whole = scan.join(places, F.col("file").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("of_block")) & (F.col("part") == F.col("of_part")))
    ends = F.concat("crossing", F.transform(F.col("places")[F.col("shift")], lambda x: ((x + F.col("at")) / width).cast("long")))
    spread = whole.select("file", "done", "previous", "n_ends", F.concat(ends, "rest").alias("stops"))
    each = spread.select("file", "done", "previous", "n_ends", "stops", F.posexplode("stops").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.col("stops")[F.col("i") - 1]) + 1
    return each.select("file", (F.col("done") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("n_ends")).alias("closed"))
