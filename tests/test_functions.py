"""Edge cases of the column functions, computed by hand."""

import pytest
from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.functions import numbers as N
from concord.functions import text as X


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def one(spark, schema, rows, column):
    return [r[0] for r in values(spark, schema, rows, column)]


def test_decoders_differ_in_rounding_and_excludes(spark):
    rows = [("1",), ("1.0",), ("0.6",), ("2.5",), ("3",), ("x",), (None,), ("nan",), ("0",), ("2",)]
    plain = one(spark, "v string", rows, L.decode_codes(F.col("v"), 1, (0, 2)))
    assert plain == [1, 1, None, None, None, None, None, None, 0, 0]
    rounded = one(spark, "v string", rows, L.decode_presence(F.col("v"), 1, (0, 2, 3), (3,)))
    assert rounded == [1, 1, 1, 0, None, None, None, None, 0, 0]


def test_age_bands_are_closed_on_the_right(spark):
    rows = [(x,) for x in ("0", "0.5", "40", "40.1", "60", "80", "81", "200", "201", "-3", None, "old")]
    assert one(spark, "v string", rows, L.age_band(F.col("v"))) == [None, "<40", "<40", "40-60", "40-60", "60-80", "80+", "80+", None, None, None, None]


def test_missing_against_a_threshold(spark):
    assert one(spark, "v double", [(2.0,), (1.0,), (None,), (float("nan"),)], L.at_least(F.col("v"), 2)) == [1, 0, 0, 0]
    assert one(spark, "v double", [(2.0,), (1.0,), (0.0,), (None,)], L.severity(F.col("v"))) == [1, 0, None, None]


def test_answers(spark):
    rows = [(" YES",), ("n",), ("maybe",), (None,), ("True",), ("0",)]
    assert one(spark, "v string", rows, L.yes_no(F.col("v"))) == [1, 0, -1, -1, 1, 0]
    assert one(spark, "v string", [("Adeq.",), (" suboptimal x",), ("NON",), (None,), (" other ",)], L.image_quality(F.col("v"))) == ["adequate", "suboptimal", "non-diagnostic", "", "other"]


def test_lookup_by_name_and_first_maximum(spark):
    rows = [("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), (None, 1.0, 2.0)]
    assert one(spark, "n string, a double, b double", rows, L.column_named_by(F.coalesce("n", F.lit("?")), {"a": F.col("a"), "b": F.col("b")})) == [1, 2, None, None]
    assert one(spark, "a double, b double", [(1.0, 1.0), (None, 2.0), (0.0, 3.0)], L.argmax_class([F.col("a"), F.col("b")], ["x", "y"])) == ["x", "y", "y"]


def test_case_ids(spark):
    rows = [("mimic", "files/p1/s2/abc.jpg"), ("chexpert", "CheXpert-v1.0/train/p/view1.JPG"), ("nih_cxr14", "images/0001.b.png"), ("padchest", "a.b.png"), ("vindr_cxr", "k")]
    assert one(spark, "s string, k string", rows, X.case_id(F.col("s"), F.col("k"))) == ["mimic__abc", "chexpert__train_p_view1", "nih_cxr14__0001.b", "padchest__a.b", "vindr_cxr__k"]


def test_paths(spark):
    rows = [("padchest", "k.png", "1.0"), ("padchest", "k.png", None), ("vindr_cxr", "k", "x"), ("rexgradient", "../../a/k", None), ("unknown", "k", None), ("mimic", "files/a", None)]
    path = X.image_path(F.col("d"), F.lit("/r"), F.col("k"), F.lit("test"), F.col("s"))
    assert one(spark, "d string, k string, s string", rows, path) == ["/r/preprocessed224/1/k.png", "/r/preprocessed224/k.png", "/r/preprocessed224/test/k.jpg", "/r/a/k", None, "/r/preprocessed224/a"]
    assert one(spark, "p string", [("/x/pool/a",), ("/y",)], X.rerooted(F.col("p"), "pool", "/new")) == ["/new/pool/a", "/y"]


def test_cells_and_codes(spark):
    assert one(spark, "v string", [("['B', \"A\"]",), ("['B']",), (" plain ",), ("[]",)], X.vendor(F.col("v")))[:3] == ["mixed: A + B", "B", "plain"]
    assert one(spark, "v string", [("1.0",), ("1.5",), ("x",), (None,), ("12",)], X.integral_text(F.col("v"))) == ["1", "1.5", "x", None, "12"]
    rows = [("J18.9", "j18"), ("A", "B"), ("", "AB"), ("C1", "C1")]
    a, b = X.normal_code(F.col("a")), X.normal_code(F.col("b"))
    assert one(spark, "a string, b string", rows, X.code_distance(a, b)) == [1, 2, 2, 0]
    rows = [("a", "a", None, None), ("a", "b", None, None), ("a", "b", "g", None), ("a", "b", "g", "g")]
    assert one(spark, "a string, b string, g string, h string", rows, X.taxonomy_distance(F.col("a"), F.col("b"), F.col("g"), F.col("h"))) == [0, 1, 2, 1]


def test_sections(spark):
    rows = [(" a ", "b", "c"), (None, " ", " c "), (None, None, None), ("", "b", None)]
    assert one(spark, "x string, y string, z string", rows, X.combined_sections(F.col("x"), F.col("y"), fallback=F.col("z"))) == ["a\nb", "c", "", "b"]


def test_numbers(spark):
    assert one(spark, "a double, b double", [(0.7, 0.9), (0.7, 0.5), (0.7, None)], N.chance_corrected(F.col("a"), F.col("b"))) == [pytest.approx(0.5), None, None]
    assert one(spark, "v double", [(0.1234,), (None,), (-1.0,)], N.percent(F.col("v"))) == [12.3, None, -100.0]
    with pytest.raises(Exception, match="no share"):
        one(spark, "v double", [(12.0,)], N.percent(F.col("v")))
    assert one(spark, "q double, p double", [(None, 0.2), (0.1, 0.2), (None, None)], N.effective_p(F.col("q"), F.col("p"))) == [0.2, 0.1, 1.0]
