"""Scoring found changes against an answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..tables import written
from .assign import greedy_one_to_one
from .grid import with_cells

MIN_IOU = 0.3


def score_pairs(found: DataFrame, key: DataFrame) -> DataFrame:
    """``key``: comparison_id, key_id (its order), change_type, kind, x0..y1, old_value, new_value (null: not asked); ``found`` has
    the same with found_id (its order).  Pairs of equal type, kind and values that overlap enough, one to one in key order."""
    f = found.select("comparison_id", "change_type", "kind", "found_id", *[F.col(c).alias("f_" + c) for c in ("x0", "y0", "x1", "y1", "old_value", "new_value")])
    # Boxes of which one is more than 1 / MIN_IOU times as long as the other do not overlap enough; the others meet on cells of their own
    # size: a found box on the cells of its level (a power of two), a key's box on those of the levels about its own.
    level = lambda p: F.floor(F.log2(F.greatest(F.col(p + "x1") - F.col(p + "x0"), F.col(p + "y1") - F.col(p + "y0")))).cast("int")
    some = lambda p: (F.col(p + "x1") > F.col(p + "x0")) & (F.col(p + "y1") > F.col(p + "y0"))
    size = F.power(F.lit(2.0), F.col("_level") + 1)
    corners = lambda p: [F.col(p + c) for c in ("x0", "y0", "x1", "y1")]
    f = with_cells(f.where(some("f_")).withColumn("_level", level("f_")), *corners("f_"), size)
    k = key.where(some("")).withColumn("_level", F.explode(F.sequence(level("") - 2, level("") + 2)))
    pairs = with_cells(k, *corners(""), size).join(f, ["comparison_id", "change_type", "kind", "_level", "_cx", "_cy"])
    over = iou(tuple(F.col("f_" + c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))) >= MIN_IOU
    same = [F.col(c).isNull() | (F.col(c) == F.col("f_" + c)) for c in ("old_value", "new_value")]
    pairs = pairs.where(over & F.coalesce(same[0] & same[1], F.lit(False)))
    # Key order first, then the order of the found changes: a greedy pass by (key, found).
    ranked = pairs.select("comparison_id", F.col("key_id").cast("double").alias("distance"), F.col("key_id").alias("old_id"), F.col("found_id").alias("new_id")).distinct()
    return greedy_one_to_one(ranked)


def precision_recall(found: DataFrame, key: DataFrame, sheets: DataFrame) -> DataFrame:
    """(comparison_id, matched, found, expected, precision, recall); an empty side scores 1."""
    matched = written(score_pairs(found, key), "scored").groupBy("comparison_id").agg(F.count("*").alias("matched"))
    n = found.groupBy("comparison_id").agg(F.count("*").alias("found"))
    k = key.groupBy("comparison_id").agg(F.count("*").alias("expected"))
    out = sheets.select("comparison_id")
    for d in (matched, n, k):
        out = out.join(d, "comparison_id", "left")
    out = out.na.fill(0, ["matched", "found", "expected"])
    rate = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(F.lit(1.0))
    return out.select("comparison_id", "matched", "found", "expected", rate("found").alias("precision"), rate("expected").alias("recall"))


def inventory(entities: DataFrame) -> DataFrame:
    """Counts by kind and the sorted texts of every sheet."""
    return entities.groupBy("comparison_id", "revision").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("linework", "text", "dimension")], F.array_join(F.array_sort(F.collect_list("text_payload")), "|").alias("texts")
    )
