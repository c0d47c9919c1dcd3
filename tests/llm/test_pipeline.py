"""The corpus pipeline stage by stage on planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P

R = random.Random(11)
EN = "the and this with from that have would there people water house garden river stone light paper music".split()
DE = "und der nicht mit eine haben würde auch über leute wasser haus garten fluss stein licht papier musik".split()


def tables(spark, folder):
    rows, labels = [], []
    for i in range(240):
        words, lang = R.choice([(EN, "en"), (DE, "de")])
        good = R.random() < 0.7
        text = " ".join(R.choices(words, k=80)) + "." if good else " | ".join(R.choices(words, k=60)) + " !!"
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), 0))
    secret = " ".join(R.sample(EN, 12))
    good = [i for i, (_, y, _) in enumerate(labels) if y]
    rows += [(1000, rows[good[0]][1], rows[good[0]][2], "s", 1), (1001, rows[good[1]][1] + " " + secret, "en", "s", 1), (1002, None, "en", "s", None), (1003, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, good


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, labels, good = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.collect()}
    assert {1002, 1003}.isdisjoint(kept["language"]) and kept["language"] >= {r[0] for r in rows[:240]}
    bad = {i for i, y, _ in labels if not y}
    assert len(kept["quality"] & bad) <= 2 and len(kept["quality"] & set(good)) >= len(good) - 2
    assert 1000 not in kept["near_duplicates"] and good[0] in kept["near_duplicates"]
    assert kept["decontamination"] == kept["near_duplicates"] - {1001}
    packed = P.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == kept["decontamination"]


def test_stages_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_repeats_and_rows_without_ids(spark):
    same, other = "one two three four five six seven", "quite another text that has nothing in common with it"
    rows = [(1, same), (1, same), (5, same), (None, same), (None, same), (2, other), (None, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit("own"))
    kept = P.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, same), (0, same), (0, same), (2, other), (0, ""), (3, "")])


def test_quality_without_declared_lengths(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, labels, good = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    out = P.good_quality(spark, docs, folder)
    assert out.columns == docs.columns and len({r.doc_id for r in out.collect()} & set(good)) >= len(good) - 4
