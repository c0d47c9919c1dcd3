"""npz and npy archives of matrices as a data source and a sink of Spark.

An archive's directory and the headers of its members are read by their byte ranges, so the shape of an archive costs
kilobytes. Rows of a stored member are read by range, several tasks to an archive; a compressed member is one
task's. Paths are those that pyarrow's file systems open: local or mounted ones, HDFS, object stores. Written
archives are one for each task, and appear when the job commits; an aborted job leaves none.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a matrix that a task reads at most.
RANGE_BYTES = 64 << 20
#: Rows of a batch.
BATCH_ROWS = 1024
IDS, MATRIX = "case_ids", "embeddings"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The npz files at a path: itself, or those of the folder, but for hidden ones."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz") and not any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/")))
    prefix = path[: path.index("://") + 3] if "://" in path else "file://" if path.startswith("file:") else ""
    return [prefix + n for n in names]


@dataclass(frozen=True)
class Member:
    """A member's array: where its values begin in the archive, or -1 if they are compressed."""

    name: str
    shape: tuple[int, ...]
    dtype: str
    fortran: bool
    first: int


def members(path: str) -> dict[str, Member]:
    """The arrays of an archive, by its directory and the members' headers alone."""
    store, at = _opened(path)
    out = {}
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with z.open(info) as m:
                version = np.lib.format.read_magic(m)
                shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
                header = m.tell()
            first = -1
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)
                first = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4))) + header
            name = info.filename.removesuffix(".npy")
            out[name] = Member(name, shape, dtype.str, fortran, first)
    return out


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, n_rows, width, dtype, compressed) of every array of the archives, from headers; width is NULL for a list of values."""
    files = spark.createDataFrame([(a,) for a in archives(path)], "path string")

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = list(members(p).values())
                cols = [[p] * len(found), [m.name for m in found], [m.shape[0] if m.shape else 1 for m in found], [m.shape[1] if len(m.shape) > 1 else None for m in found], [m.dtype for m in found], [m.first < 0 for m in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["path", "name", "n_rows", "width", "dtype", "compressed"])

    return files.mapInArrow(run, "path string, name string, n_rows long, width long, dtype string, compressed boolean")


def rows_of(path: str, member: Member, first: int, n: int) -> np.ndarray:
    """Rows of an array, by their bytes if it is stored in rows."""
    store, at = _opened(path)
    if member.first >= 0 and not (member.fortran and len(member.shape) > 1):
        dtype = np.dtype(member.dtype)
        size = dtype.itemsize * int(np.prod(member.shape[1:], dtype=np.int64))
        with store.open_input_file(at) as f:
            f.seek(member.first + first * size)
            return np.frombuffer(f.read(n * size), dtype).reshape(n, *member.shape[1:])
    with store.open_input_file(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
        return z[member.name][first : first + n]


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path = [f.name for f in schema], options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Rows]:
        out = []
        for path in archives(self.path):
            found = members(path)
            if IDS not in found or MATRIX not in found:
                raise ValueError(f"{path} holds no {MATRIX} with {IDS}")
            ids, m = found[IDS], found[MATRIX]
            if len(m.shape) != 2 or ids.shape != m.shape[:1]:
                raise ValueError(f"{path}: {ids.shape[0] if ids.shape else 1} ids for a matrix of {m.shape}")
            rows = m.shape[0]
            if m.first >= 0 and not m.fortran:
                rows = max(1, self.range_bytes // max(1, np.dtype(m.dtype).itemsize * m.shape[1]))
            out += [_Rows(path, at, min(rows, m.shape[0] - at)) for at in range(0, m.shape[0], max(1, rows))]
        return out or [_Rows("", 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        found = members(partition.path)
        whole = {}
        if "case_id" in self.names:
            whole["case_id"] = [x.decode() if isinstance(x, bytes) else str(x) for x in rows_of(partition.path, found[IDS], partition.first, partition.n).tolist()]
        if "embedding" in self.names:
            whole["embedding"] = rows_of(partition.path, found[MATRIX], partition.first, partition.n).astype(np.float32)
        for at in range(0, partition.n, BATCH_ROWS):
            n, cols = min(BATCH_ROWS, partition.n - at), []
            for name in self.names:
                if name == "path":
                    cols.append(pa.array([partition.path] * n, pa.string()))
                elif name == "row":
                    cols.append(pa.array(partition.first + at + np.arange(n)))
                elif name == "case_id":
                    cols.append(pa.array(whole["case_id"][at : at + n], pa.string()))
                else:
                    part = whole["embedding"][at : at + n]
                    offsets = pa.array(np.arange(n + 1) * part.shape[1], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(part.ravel())))
            yield pa.RecordBatch.from_arrays(cols, names=self.names)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes an archive under a hidden name; the commit gives them their names, an abort deletes them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.compressed = options.get("compressed", "false").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        ids, parts = [], []
        for batch in batches:
            at = batch.schema.names
            ids += batch.column(at.index("case_id")).to_pylist()
            lists = pa.concat_arrays([batch.column(at.index("embedding"))])
            if lists.null_count or any(i is None for i in ids[-batch.num_rows :]):
                raise ValueError("an archive holds no absent ids or vectors")
            sizes = np.diff(lists.offsets.to_numpy())
            if len(set(sizes.tolist())) > 1:
                raise ValueError("the vectors of an archive are of one width")
            parts.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(sizes), -1))
        if not ids:
            return _Written(None, 0)
        if len({p.shape[1] for p in parts if len(p)}) > 1:
            raise ValueError("the vectors of an archive are of one width")
        store, at = _opened(self.path)
        name = f"part-{uuid.uuid4().hex}.npz"
        store.create_dir(f"{at}/.writing-{self.job}", recursive=True)
        with store.open_output_stream(f"{at}/.writing-{self.job}/{name}") as f:
            (np.savez_compressed if self.compressed else np.savez)(f, **{IDS: np.array([str(i) for i in ids]), MATRIX: np.concatenate(parts)})
        return _Written(name, len(ids))

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        before = [p for p in archives(self.path)] if self.overwrite else []
        for p in before:
            store.delete_file(_opened(p)[1])
        for m in messages:
            if m is not None and m.name:
                store.move(f"{at}/.writing-{self.job}/{m.name}", f"{at}/{m.name}")
        self._clear(store, at)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/.writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/.writing-{self.job}")


class NpzSource(DataSource):
    """format("npz"): rows (path, row, case_id, embedding) of archives that hold `case_ids` and a matrix `embeddings`; columns that a schema leaves out are not read."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, row long, case_id string, embedding array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        names = {f.name for f in schema}
        if not {"case_id", "embedding"} <= names:
            raise ValueError("an archive is written from case_id and embedding")
        return _Writer(self.options, overwrite)


def read_npz_rows(spark: SparkSession, path: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of archives, of which only `columns` are read; large stored ones by several tasks."""
    spark.dataSource.register(NpzSource)
    kinds = {"path": "string", "row": "long", "case_id": "string", "embedding": "array<float>"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("npz").schema(schema).option("rangebytes", str(range_bytes)).load(path)


def write_npz(df: DataFrame, path: str, compressed: bool = False, overwrite: bool = True) -> None:
    """Archives of (case_id, embedding), one for each partition that has rows. Ids are written as text, vectors as 4-byte floats of one width for each archive."""
    df.sparkSession.dataSource.register(NpzSource)
    rows = df.selectExpr("cast(case_id AS string) AS case_id", "cast(embedding AS array<float>) AS embedding")
    rows.write.format("npz").mode("overwrite" if overwrite else "append").option("compressed", str(compressed).lower()).save(path)
