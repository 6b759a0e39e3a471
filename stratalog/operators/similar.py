"""Near-duplicate hints between objects: blocked on a shared title word, then scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import content_words, strip_instances

TITLE, BODY, LEAST = 0.65, 0.35, 0.5


def _jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(ta, tb, ba, bb):
    """0.65 of the titles' overlap (of the smaller set if it has two words) and 0.35 of the bodies' Jaccard."""
    small = F.least(F.size(ta), F.size(tb))
    title = F.when(small >= 2, F.size(F.array_intersect(ta, tb)) / small).otherwise(_jaccard(ta, tb))
    return F.round(TITLE * title + BODY * _jaccard(ba, bb), 6)


def hints(objects: DataFrame) -> DataFrame:
    """(left_id, right_id, score, differ) of objects of one kind that score at least 0.5.

    Without a common title word the score is at most 0.35, so blocking on one loses nothing; a pair is
    compared once, under the first word that it shares.
    """
    words = objects.select(
        "id", "kind", "n_disagree", content_words(strip_instances(F.col("title"))).alias("t"), content_words(F.col("body")).alias("b")
    )
    rows = words.withColumn("word", F.explode("t"))
    left, right = rows.alias("l"), rows.alias("r")
    pairs = left.join(right, (F.col("l.kind") == F.col("r.kind")) & (F.col("l.word") == F.col("r.word")) & (F.col("l.id") < F.col("r.id")))
    pairs = pairs.where(F.element_at(F.array_intersect("l.t", "r.t"), 1) == F.col("l.word"))
    score = overlap(F.col("l.t"), F.col("r.t"), F.col("l.b"), F.col("r.b"))
    differ = (F.col("l.n_disagree") > 0) | (F.col("r.n_disagree") > 0)
    return pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), score.alias("score"), differ.alias("differ")).where(F.col("score") >= LEAST)
