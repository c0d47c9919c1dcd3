"""npz archives: headers alone, row ranges, round trips, commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.sources import npz


def test_ranges_and_headers(spark, tmp_path):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(1000, 8)).astype(np.float32), r.normal(size=(50, 8))
    np.savez(tmp_path / "a.npz", case_ids=np.array([f"c{i}" for i in range(1000)]), embeddings=a)
    np.savez_compressed(tmp_path / "b.npz", case_ids=np.arange(50), embeddings=np.asfortranarray(b), extra=np.zeros((2, 3, 4)))
    np.savez(tmp_path / "_hidden.npz", x=np.zeros(3))
    df = npz.read_npz_rows(spark, f"file://{tmp_path}", range_bytes=32 * 100)
    assert df.rdd.getNumPartitions() == 11
    got = {(os.path.basename(x.path), x.row): (x.case_id, x.embedding) for x in df.collect()}
    assert len(got) == 1050 and got["a.npz", 999][0] == "c999" and np.allclose(got["a.npz", 999][1], a[999]) and np.allclose(got["b.npz", 7][1], b[7]) and got["b.npz", 7][0] == "7"
    assert [x.case_id for x in npz.read_npz_rows(spark, f"{tmp_path}/a.npz", ["case_id"]).collect()] == [f"c{i}" for i in range(1000)]
    told = {(os.path.basename(x.path), x.name): (x.n_rows, x.width, x.compressed) for x in npz.shapes(spark, str(tmp_path)).collect()}
    assert told["a.npz", "embeddings"] == (1000, 8, False) and told["b.npz", "embeddings"] == (50, 8, True) and told["b.npz", "case_ids"] == (50, None, True) and len(told) == 5


def test_shape_of_an_archive_of_four_gigabytes_reads_little(tmp_path, monkeypatch):
    rows, width = 1 << 20, 1024
    path, data = tmp_path / "large.npz", tmp_path / "m.npy"
    header = np.lib.format.header_data_from_array_1_0(np.zeros((0, width), np.float32)) | {"shape": (rows, width)}
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z, z.open(zipfile.ZipInfo("embeddings.npy"), "w", force_zip64=True) as m:
        np.lib.format.write_array_header_1_0(m, header)
        at, size, n = z.fp.tell(), rows * width * 4, m  # the values are a hole in the file
        z.fp.seek(size - 1, 1)
        z.fp.write(b"\x01")
        n._file_size, n._crc = n._file_size + size, 0
        n._compress_size = getattr(n, "_compress_size", 0)
    assert os.path.getsize(path) > 4 << 30 and at < 1000 and not data.exists()
    read = []
    real = npz._opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            out = self.f.read(n) if n is not None and n >= 0 else self.f.read()
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

    class Store:
        def open_input_file(self, p):
            return Counted(open(p, "rb"))

    monkeypatch.setattr(npz, "_opened", lambda p: (Store(), p))
    m = npz.members(str(path))["embeddings"]
    assert m.shape == (rows, width) and sum(read) < 100_000
    last = npz.rows_of(str(path), m, rows - 1, 1)
    assert last.shape == (1, width) and last.view(np.uint32)[0, -1] == 1 << 24
    assert real


@pytest.mark.parametrize("compressed", [False, True])
def test_round_trip(spark, tmp_path, compressed):
    rows = [(i, [float(i), i / 3, -1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id long, embedding array<double>").withColumn("other", F.lit(1)).repartition(4)
    path = f"file://{tmp_path}/out"
    npz.write_npz(df, path, compressed)
    back = {r.case_id: r.embedding for r in npz.read_npz_rows(spark, path).collect()}
    assert back == {str(i): [float(np.float32(x)) for x in v] for i, v in rows} and len(npz.archives(path)) == 4
    npz.write_npz(df.filter("case_id < 10"), path, compressed)
    assert npz.read_npz_rows(spark, path, ["case_id"]).count() == 10
    npz.write_npz(df.filter("case_id < 5"), path, compressed, overwrite=False)
    assert npz.read_npz_rows(spark, path, ["case_id"]).count() == 15
    npz.write_npz(df.limit(0), path)
    assert npz.archives(path) == [] and npz.read_npz_rows(spark, path).count() == 0


def test_failures_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(i, [1.0] * (1 if i < 50 else 2)) for i in range(100)], "case_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="one width"):
        npz.write_npz(df, path)
    with pytest.raises(Exception, match="absent"):
        npz.write_npz(df.limit(3).withColumn("embedding", F.lit(None).cast("array<double>")), path)
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
    np.savez(tmp_path / "x.npz", embeddings=np.zeros((3, 2)), case_ids=np.arange(2))
    with pytest.raises(Exception, match="2 ids for a matrix"):
        npz.read_npz_rows(spark, f"{tmp_path}/x.npz").count()
    with pytest.raises(Exception):
        npz.read_npz_rows(spark, f"{tmp_path}/absent.npz").count()
