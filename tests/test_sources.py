"""Readers, writers, units and the stream, on files in a temporary folder."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.plans import units as U
from concord.sources import tables as T
from concord.streaming.ingest import ingest_vectors


def test_csv_falls_back_to_latin(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Müller\n2,\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("id;name\n1;Müller\n".encode())
    assert [tuple(r) for r in T.read_csv(spark, f"{tmp_path}/a.csv", "id int, name string").collect()] == [(1, "Müller"), (2, None)]
    assert T.read_sniffed_csv(spark, f"{tmp_path}/b.csv", "id int, name string").first().name == "Müller"
    assert T.read_sniffed_csv(spark, f"{tmp_path}/none.csv", "id int") is None


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "g__1.jsonl").write_text('{"a": 1, "b": "x"}\n{bad\n\n{"a": 2}\n')
    (tmp_path / "h__1.jsonl").write_text('{"a": 9}\n')
    rows, bad = T.read_jsonl(spark, f"{tmp_path}/g__*.jsonl", "a int, b string")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "x"), (2, None)] and bad.first()[0] == 1


def test_fixed_width_codes_and_listing(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("00001 j18.9   0 Pneumonia\n00002 A00     1 Cholera\nshort\n00003 J18.9   0 again\n")
    assert sorted(r.code for r in T.read_codes(spark, f"{tmp_path}/codes.txt").collect()) == ["A00", "J189"]
    for c in ("x", "y"):
        (tmp_path / "tree" / c).mkdir(parents=True)
        (tmp_path / "tree" / c / "1.png").write_bytes(b"p")
    files = T.list_files(spark, f"{tmp_path}/tree", "*.png")
    assert sorted(r["class"] for r in files.collect()) == ["x", "y"]
    df = spark.createDataFrame([(f"{tmp_path}/tree/x/1.png",), (f"{tmp_path}/tree/x/2.png",)], "p string")
    assert T.with_files(df, files, "p").count() == 1


def test_reports_come_from_files_first(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.txt").write_text("from file")
    df = spark.createDataFrame([(1, f"{tmp_path}/r/1.txt", "inline"), (2, "none", "inline"), (3, "none", " ")], "i int, p string, t string")
    assert sorted((r.i, r.report) for r in T.report_texts(spark, df, "p", "t", f"{tmp_path}/r").collect()) == [(1, "from file"), (2, "inline")]


def test_npz_and_shape(spark, tmp_path):
    np.savez(tmp_path / "pool.npz", embeddings=np.eye(3, dtype=np.float32), case_ids=np.array(["a", "b", "c"]))
    df = T.read_npz(spark, f"{tmp_path}/pool.npz", F.lit("e"), F.lit("p"))
    assert T.shape(df) == (3, 3) and df.filter("case_id = 'b'").first().embedding == [0.0, 1.0, 0.0]


def test_tables_know_their_parameters(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.range(3)
    T.write_table(df, path, params={"n": 3, "x": float("inf")})
    assert T.is_valid(spark, path, {"n": 3, "x": float("nan")}) and not T.is_valid(spark, path, {"n": 4, "x": None})
    assert T.moved_params(spark, path, {"n": 4, "x": None}) == ["n"] and T.moved_params(spark, f"{tmp_path}/u", {}) is None
    with pytest.raises(T.NotReady):
        T.write_table(df.limit(0), path)


def test_units_resume(spark, tmp_path):
    path, seen = f"{tmp_path}/out", []

    def compute(units):
        seen.append(sorted(r.unit for r in units.collect()))
        return units.withColumn("v", F.length("unit"))

    first = spark.createDataFrame([("a",), ("bb",)], "unit string")
    assert U.run_units(first, compute, path, {"k": 1}).count() == 2
    more = first.union(spark.createDataFrame([("ccc",)], "unit string"))
    assert U.run_units(more, compute, path, {"k": 1}).count() == 3 and seen[-1] == ["ccc"]
    assert U.run_units(more, compute, path, {"k": 1}).count() == 3 and len(seen) == 2
    U.run_units(first, compute, path, {"k": 2})
    assert seen[-1] == ["a", "bb"] and spark.read.parquet(path).count() == 2


def test_panels_runs_and_configuration(spark):
    panel = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "encoder string, role int")
    assert U.panel_pairs(panel).count() == 3 and U.panel_pairs(panel, ordered=True).count() == 6 and U.panel_pairs(panel, group="role").count() == 1
    runs = U.runs({"arm": ["x", "y"], "seed": [0, 1]}, spark, lambda r: r["arm"] == "x")
    assert sorted(r.run_id for r in runs.collect()) == ["x__0", "x__1"]
    assert U.missing_members(panel, panel.filter("role = 1"), "encoder").first().encoder == "c"
    assert U.resolved({"root": "/r", "a": {"b": "${root}/x"}, "c": "${a.b}/y", "d": "${nope}"}) == {"root": "/r", "a": {"b": "/r/x"}, "c": "/r/x/y", "d": "${nope}"}


def test_stream_adds_each_case_once(spark, tmp_path):
    rows = [("e", "p", 1, [1.0]), ("e", "p", 2, [2.0])]
    schema = "encoder string, pool string, case_id long, embedding array<float>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/a")
    ingest_vectors(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    spark.createDataFrame([*rows, ("e", "p", 3, [3.0])], schema).write.parquet(f"{tmp_path}/in/b")
    ingest_vectors(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.case_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    assert json.dumps(sorted(spark.read.parquet(f"{tmp_path}/out").columns)) == '["batch", "case_id", "embedding", "encoder", "pool"]'


def test_intermediate_tables_are_cleared(spark):
    import os

    from concord.sources import shared

    shared.clear(spark)
    df = shared.cut(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert shared.clear(spark) == 1 and not os.path.exists(path) and shared.clear(spark) == 0
