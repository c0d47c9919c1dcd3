"""Hard negatives: for an anchor and a positive, the nearest rows of other labels that are clearly less near.

Two searches by distance keys. The first finds an anchor's positives: what lies around its own key
gives a score that the best must reach, and one more scan down to that score certifies them. The second goes
down from the positives' scores until every positive has its negatives or the least score allowed is passed.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm import rings
from concord.llm.common import materialise

POSITIVES = 5
NEGATIVES = 3
#: Percent of a positive's score between which its negatives lie.
LEAST, MOST = 50, 95
#: Radii of further scans for an anchor without enough positives, as shares of the common length; then all rows.
RADII = (0.25, 0.5, 1.0)
#: How far scans for negatives go down, as shares of the way from MOST to LEAST.
DEPTHS = (0.1, 0.4, 1.0)

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _taken(hits: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks gave for each query and slot, with their rank."""
    order = Window.partitionBy("set", "at", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(index: rings.Rings, k: int) -> DataFrame:
    """(set, at, rank, id, score): each anchor's k best other rows of its label."""

    def choose(scores, same, own, more):
        return [rings.best(scores, same & ~own, k)]

    def places(batches):
        for batch in batches:
            for key, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids) // 8
                rows = pickle.loads(data).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array((rows * rows).sum(1))], names=["set", "at", "square"])

    pending = materialise(index.sets.select("set", "ids", "data").mapInArrow(places, "set long, at int, square double"), "anchors").withColumn("threshold", F.lit(None).cast("double"))
    done, more = None, F.array().cast("array<long>")
    for radius in [*RADII, None, None]:
        hits = materialise(_taken(rings.scan(index, pending.withColumn("more", more), choose), k), "positives")
        found = hits.groupBy(F.col("set").alias("_set"), F.col("at").alias("_at")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
        state = pending.join(found, (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at")), "left")
        enough = F.coalesce(F.col("n") >= k, F.lit(False))
        all_read = F.coalesce(F.col("threshold") == float("-inf"), F.lit(False))
        certain = all_read | (enough & F.coalesce(F.col("least") >= F.col("threshold"), F.lit(False)))
        state = materialise(state.withColumn("certain", certain), "state")
        sure = hits.join(state.filter("certain").select(F.col("set").alias("_set"), F.col("at").alias("_at")), (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at")), "left_semi")
        done = sure if done is None else done.unionByName(sure)
        wider = F.lit(float("-inf")) if radius is None else (F.col("square") + index.space.length2 * (1 - radius**2)) / 2
        pending = state.filter("NOT certain").select("set", "at", "square", F.when(enough, F.col("least")).otherwise(wider).alias("threshold"))
        if pending.isEmpty():
            return done
    raise AssertionError("a scan of all rows left an anchor open")


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = rings.SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where is_anchor holds.

    Scores are exact inner products of vectors with components floor(scale * x), ties go to the smaller id. Positives are the
    best rows of the anchor's label, negatives of a positive the best of another label with a score of `least` to
    `most` percent of its own; a positive without any has no row. Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part; a shorter vector counts as ending in zeros. Rows that share the anchor's id are
    neither; else rows that repeat count each for itself, as anchors too. An empty table, or one without anchors,
    gives no rows; other columns do not matter. A score that leaves a long fails the query.
    """
    index = rings.build(vectors, vec_id, embedding, label, is_anchor, scale)
    if index is None or index.sets.isEmpty():
        return vectors.sparkSession.createDataFrame([], _RESULT)
    found = materialise(_positives(index, positives), "positives")

    def choose(scores, same, own, more):
        out, other = [], ~same & ~own
        for slot in range(positives):
            lists = [(-(-m[slot] * least // 100), m[slot] * most // 100) if slot < len(m) else (1, 0) for m in more]
            low, high = (np.array([x[j] for x in lists], scores.dtype)[:, None] for j in (0, 1))
            out.append(rings.best(scores, other & (scores >= low) & (scores <= high), negatives))
        return out

    scored = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])

    def open_slot(score, slot):
        """A positive whose negatives may be below the threshold."""
        got = F.col("slots")[slot]
        full = F.coalesce((got["n"] >= negatives) & (got["worst"] >= F.col("threshold")), F.lit(False))
        return (score >= 0) & ~full & (score.cast("double") * least / 100 < F.col("threshold"))

    pending = found.groupBy("set", "at").agg(scored.alias("more"))
    pending = pending.withColumn("smallest", F.array_min(F.filter("more", lambda x: x >= 0)).cast("double")).filter("smallest IS NOT NULL")
    done = None
    for depth in DEPTHS:
        percent = most - (most - least) * depth
        down = F.col("smallest") * percent / 100
        last = depth == DEPTHS[-1]  # no positive allows a negative below
        wanted = pending.withColumn("threshold", down * (1 - 1e-9) - 1 if last else down)
        hits = materialise(_taken(rings.scan(index, wanted, choose), negatives), "negatives")
        slots = hits.groupBy("set", "at", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).groupBy(F.col("set").alias("_set"), F.col("at").alias("_at")).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("n", "worst")))).alias("slots"))
        state = wanted.join(slots, (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at")), "left")
        is_open = F.exists(F.zip_with("more", F.sequence(F.lit(0), F.size("more") - 1), open_slot), lambda x: x)
        state = materialise(state.withColumn("open", F.lit(False) if last else is_open), "state")
        sure = hits.join(state.filter("NOT open").select(F.col("set").alias("_set"), F.col("at").alias("_at")), (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at")), "left_semi")
        done = sure if done is None else done.unionByName(sure)
        pending = state.filter("open").select("set", "at", "more", "smallest")
        if pending.isEmpty():
            break

    def named(batches):
        for batch in batches:
            for key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["_set", "_at", "anchor_id"])

    anchors = index.sets.select("set", "ids").mapInArrow(named, "_set long, _at int, anchor_id long")
    pairs = found.join(anchors, (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at"))).select("_set", "_at", (F.col("rank") - 1).alias("_slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    same = (F.col("set") == F.col("_set")) & (F.col("at") == F.col("_at")) & (F.col("slot") == F.col("_slot"))
    return done.join(pairs, same).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
