"""Kept columns with any names, headers of any length, parts read back, rows that share an id."""

import re

import pytest
from pyspark.sql import functions as F

from concord.llm import bitsliced, chat, decontaminate, langid, packing, quality, simhash, tokencount, warc
from concord.llm.query_warc import replica
from tests.llm.test_operators import DOCS, documents

INTERNAL = sorted({m for module in (packing, simhash, decontaminate, langid, quality, tokencount) for m in re.findall(r"""["'](_?[a-z]+(?:_[a-z]+)*)["']""", open(module.__file__).read())} | {f"column_{i}" for i in range(4)})


def clashing(spark, texts, own=("doc_id", "text", "lang", "source", "n_chars")):
    return documents(spark, texts).withColumns({c: F.lit("clash") for c in INTERNAL if c not in own})


TEXTS = ["the house and the water of the garden", "the house and the water of the garden", "", None, "über das haus und der garten"]


def test_packing_and_near_duplicates_with_every_internal_name(spark):
    assert len(INTERNAL) > 60 and "_rank" in INTERNAL and "label_fp" in INTERNAL
    docs = clashing(spark, TEXTS)
    rows = packing.pack(docs, capacity=64)
    kept = [c for c in docs.columns if c != "text" and c not in packing._NEW]
    assert rows.columns[: len(kept)] == kept and {r.doc_id for r in rows.collect()} == set(range(5)) and rows.first()["_rank"] == "clash"
    rows = simhash.near_duplicate_classes(docs, keeps=docs.columns)
    assert {r.doc_id: r.component_id for r in rows.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4} and rows.first().label_fp == "clash"


def test_other_operators_with_every_internal_name(spark):
    docs = clashing(spark, TEXTS)
    items = spark.createDataFrame([("a", TEXTS[0])], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.find_contamination(docs, items).filter("contaminated").collect()} == {0, 1}
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise("de")), F.lit(True))
    assert langid.predict(docs, model).count() == 5
    path, manifest = tokencount.write_flat(docs, "text", ["doc_id", *INTERNAL[:5]])
    assert manifest.count() == 5 and tokencount.count_tokens(tokencount.read_flat(spark, path)).count() == 5


def test_header_of_any_length_and_ids_in_bodies(spark):
    long = b"WARC/1.0\r\nWARC-Target-URI: http://x/" + b"a" * 100_000 + b"\r\nwarc-record-id:  <urn:late>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = b"x\r\nWARC-Record-ID: <evil>\r\n"
    none = b"WARC/1.0\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    rows = [("f", 0, long), ("f", 1, none), ("f", 2, b"WARC/1.0\r\nWARC-Record-ID: <cut>"), ("f", 3, None), ("f", 4, b"\xff\xfe\r\nWARC-Record-ID: \xe9\r\n\r\n\xff")]
    got = warc.leaves_of(spark.createDataFrame(rows, "file string, offset long, record binary")).orderBy("offset").collect()
    assert [r.id for r in got] == ["<urn:late>", "", "", "", "é"] and [r.length for r in got] == [len(r[2] or b"") for r in rows]
    page = spark.createDataFrame([(7, "http://y/" + "u" * 9000, "<p>é</p>")], "page_id long, url string, html string")
    assert warc.leaves_of(replica(page)).first().id == "<urn:page:7>"


def test_parts_are_read_back(spark):
    part = lambda kind, text=None: (kind, text, None, None)
    turns = [
        (1, 0, "user", [part("text", "see <|image|>"), part("image"), part("text", "a<"), part("audio"), part("text", ""), part("document")]),
        (1, 1, "assis\ntant", [part("text", "x <"), part("text", "|image|>"), part("text", "<|im_end|>")]),
        (1, 2, "user", []),
        (2, 0, None, None),
        (2, 1, "user", [part("image"), part("image"), part("text", "<|")]),
    ]
    df = spark.createDataFrame(turns, f"conv_id int, turn int, role string, content array<{chat.PART}>")
    out = {r.conv_id: r.p for r in chat.format_chats(df).select("conv_id", chat.read_parts(F.col("formatted")).alias("p")).collect()}
    told = {k: [(t.role, [(p.type, p.text) for p in t.parts]) for t in v] for k, v in out.items()}
    assert told[1] == [("user", [("text", "see <|image|>"), ("image", None), ("text", "a<"), ("audio", None), ("document", None)]), ("assis\ntant", [("text", "x <|image|><|im_end|>")]), ("user", [])]
    assert told[2] == [("", []), ("user", [("image", None), ("image", None), ("text", "<|")])]


def test_quality_takes_one_row_of_an_id(spark):
    rows = [(i, f"good words here {i}" if i % 2 else "bad !! bad !!", "en", "s", 20) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = docs.unionByName(docs.filter("doc_id = 3").withColumn("text", F.explode(F.array(*[F.lit(f"good words here 3 more {k}") for k in range(300)]))))
    one, other = (quality.fit(d, labels, F.lit(True)) for d in (docs, many))
    assert (one.linear == other.linear).all() and one.bias == other.bias


def test_scan_of_a_file_carries_no_places(spark):
    df = spark.createDataFrame([("f", 0, 8, bytearray(b"\x01\x00\x09\x00\x02\x00\x09\x00"))], "file string, block long, size long, data binary")
    plan = tokencount.count_tokens(df, end_id=9)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "places" not in below[: below.index("Scan")] and sorted(map(tuple, tokencount.count_tokens(df, end_id=9).collect())) == [("f", 0, 0, 1, True), ("f", 1, 2, 1, True)]


def test_index_of_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    index, blocks = bitsliced.build_index(df, "vec_id", "embedding")
    assert blocks == 1 and len(index.first().ids) == 16
    assert bitsliced.build_index(df.limit(0), "vec_id", "embedding")[0].count() <= 1


@pytest.mark.parametrize("count", [1, 3])
def test_pages_that_repeat_are_laid_out_one_after_another(spark, count):
    rows = spark.createDataFrame([("f", 0, 5, "i", "d")] * count, "file string, offset long, length long, id string, digest string")
    assert sorted(r.offset for r in warc.laid_out(rows, "offset").collect()) == [5 * k for k in range(count)]
