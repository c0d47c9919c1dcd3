"""Models and limits come from every row that can teach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import langid, quality

WORDS = "stone river light garden paper music water house people kept found early".split()


def test_language_learns_from_every_row(spark):
    docs = spark.createDataFrame([(i, f"stone {chr(0x4E00 + i)}", "en") for i in range(7000)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert all(chr(0x4E00 + i) in model.weights for i in range(7000))


def test_limit_is_the_median_of_every_row(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices(WORDS, k=r.randint(2, 9))) for _ in range(1200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    scorer, sides = langid.Scorer(model), ([], [])
    for words in map(langid.words_of, texts):
        for side, text in zip(sides, (words, langid.shuffled(words, len(words)))):
            side.append(scorer.log_likelihoods([text])[0, 0] / langid.letters_of(words))
    assert langid.limits(docs, model, F.lit(True))["en"] == pytest.approx(sum(map(np.median, sides)) / 2, abs=1e-4)


def test_quality_learns_from_every_labelled_row(spark):
    rows = [(i, "x" * (1 + i * 7 % 101)) for i in range(9000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    machine = quality.fit(docs, labels, F.lit(True))
    assert machine.mean[0] == pytest.approx(np.mean([np.log1p(len(t)) for _, t in rows]), abs=1e-12)


def test_quality_of_averaged_shards(spark):
    r = random.Random(9)
    good = [r.random() < 0.6 for _ in range(1600)]
    texts = [" ".join(r.choices(WORDS, k=40)) + "." if g else " | ".join(r.choices(WORDS, k=30)) + " BUY NOW!!" for g in good]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    machines = [quality.fit(d, labels, ~langid.held_out(), shard_rows=300) for d in (docs, docs.repartition(7))]
    assert (machines[0].linear == machines[1].linear).all() and (machines[0].factors == machines[1].factors).all()
    found = [x for x in quality.score(docs, machines[0]).withColumn("h", langid.held_out()).collect() if x.h]
    assert sum(x.predicted == good[x.doc_id] for x in found) / len(found) > 0.95
