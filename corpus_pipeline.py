"""A corpus pipeline over `documents`: language, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All
but the last return the columns of docs, whatever they are, with the rows that stay; the last
returns the packed pieces. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, langid, packing, quality, simhash
from concord.llm.common import materialise

#: No SQL expresses the tokenizer, the classifiers or XXH64.
ORACLE_SQL: str | None = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator uses, and the new name of each column."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _kept(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the table; those without letters and those nearer to shuffled letters than to their language go. Rows that repeat fare alike."""
    rows, at = _numbered(docs)
    learn = ~langid.held_out(at["doc_id"])
    model = langid.fit(rows, learn, at["doc_id"], at["text"], at["lang"])
    least = langid.limits(rows, model, learn, at["doc_id"], at["text"], at["lang"])
    if not least:
        return docs.limit(0)
    limit = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col("lang_pred")]
    found = langid.predict(rows, model, at["text"], per_letter="per_letter")
    return _kept(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("per_letter") >= limit)), at)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier predicts to be of quality 1; all, if no label is known. Rows that repeat are judged alike."""
    rows, at = _numbered(docs)
    length = at.get("n_chars", "n_chars")  # without the column, every length counts as declared right
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(at["doc_id"]), "quality")
    machine = quality.fit(rows, labels, ~langid.held_out(at["doc_id"]), at["doc_id"], at["text"], length)
    if machine is None:
        return docs
    return _kept(quality.score(rows, machine, at["text"], length).filter("predicted = 1"), at)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate class, once if its row repeats; rows without an id stay."""
    rows, at = _numbered(docs)
    key = at["doc_id"]
    classes = simhash.near_duplicate_classes(rows, key, at["text"])
    first = materialise(classes.filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("kept_id")).agg(F.count("*").alias("n")), "kept")
    stay = rows.filter(F.col(key).isNotNull()).join(first.hint("shuffle_hash"), F.col(key) == F.col("kept_id"), "left_semi")
    if not first.filter("n > 1").isEmpty():
        stay = stay.dropDuplicates([key])
    return _kept(stay.unionByName(rows.filter(F.col(key).isNull())), at)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, each row that repeats one too."""
    rows, at = _numbered(docs)
    found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), at["text"], items=False)
    return _kept(found.filter("NOT contaminated"), at)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; rows that repeat are packed each for itself."""
    return packing.pack(docs, keeps=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
