"""The language stage on texts in no learned language, random letters and short clean texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from concord.llm import langid

POOLS = {
    "en": "the and this with from that have would there people water house garden river stone light paper music".split(),
    "de": "und der nicht mit eine haben würde auch über leute wasser haus garten fluss stein licht papier musik".split(),
    "fr": "les des une avec pour dans est sont cette maison jardin rivière pierre lumière papier musique eau gens".split(),
}
FOREIGN = [
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
    "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler",
    "все люди рождаются свободными и равными в своем достоинстве и правах",
    "人人生而自由在尊严和权利上一律平等",
]


@pytest.mark.parametrize("languages", [["en"], ["en", "de"], ["en", "de", "fr"]])
def test_texts_of_no_learned_language_go(spark, languages):
    r = random.Random(7)
    learned = [(i, " ".join(r.choices(POOLS[k], k=r.choice([3, 20, 200]))), k) for i in range(240) for k in (r.choice(languages),)]
    short = [(1000 + i, " ".join(r.choices(POOLS[k], k=3)), None) for i, k in enumerate(languages * 4)]
    noise = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(n)) for n in (5, 60, 2000)]
    bad = [(2000 + i, t, None) for i, t in enumerate(FOREIGN + [t * 50 for t in FOREIGN] + noise)]
    docs = spark.createDataFrame(learned + short + bad, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    kept = {x.doc_id for x in P.language(spark, docs, "").collect()}
    assert kept == {i for i, *_ in learned + short}


def test_no_limit_without_labels(spark):
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert langid.limits(docs, model, F.lit(True)) == {} and P.language(spark, docs, "").count() == 0
