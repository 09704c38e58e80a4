"""What a run did, comparison by comparison: counts of every stage, as a table and as a log of JSON lines.

Only counts are kept, no texts or places.  They are grouped sums over the tables that the run wrote anyway, so no stage runs again.  (Metrics
observed on the way would be totals over all comparisons, and an observation leaves the session's models unable to travel to tasks.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATES


def stage_signals(entities: DataFrame, matches: DataFrame, deltas: DataFrame, unmatched: DataFrame, registrations: DataFrame | None = None, labelled: DataFrame | None = None, low: float = 0.5) -> DataFrame:
    """(comparison_id, stage, signal, value): entities by revision, anchors, pairs by tier and what is in no pair, changes by type, and
    labels under the confidence ``low``.  What did not occur has no row."""

    def count(df: DataFrame, stage: str, signal: Column) -> DataFrame:
        return df.groupBy("comparison_id", F.lit(stage).alias("stage"), signal.alias("signal")).agg(F.count("*").alias("value"))

    parts = [
        count(entities, "extracting", F.concat(F.lit("entities_"), F.col("revision"))),
        count(matches, "matching", F.col("tier")),
        count(unmatched, "matching", F.concat(F.lit("unmatched_"), F.col("revision"))),
        count(deltas, "diffing", F.col("change_type")),
    ]
    if labelled is not None:
        parts.append(count(labelled.where(F.col("semantic_confidence") < low), "classifying", F.lit("low_confidence")))
    if registrations is not None and "anchors" in registrations.columns:
        parts.append(registrations.select("comparison_id", F.lit("registering").alias("stage"), F.lit("anchors").alias("signal"), F.col("anchors").alias("value")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def log_lines(signals: DataFrame) -> DataFrame:
    """(comparison_id, line): one JSON line for each stage of a comparison, with the stage's place in the order of states."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("stage")).cast("int")
    named = signals.groupBy("comparison_id", "stage").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "value")))).alias("signals"))
    body = F.struct(F.col("comparison_id"), F.lit("stage_end").alias("event"), stage.alias("order"), F.col("signals"), F.col("stage"))
    return named.select("comparison_id", stage.alias("order"), F.to_json(body).alias("line"))


def write_log(signals: DataFrame, folder: str) -> None:
    """Append the lines to ``folder``, a part for each comparison, so that a comparison's log is read without the others'."""
    log_lines(signals).select("comparison_id", "line").repartition("comparison_id").write.mode("append").partitionBy("comparison_id").text(folder)


def read_log(spark, folder: str, comparison_id: int) -> DataFrame:
    """(comparison_id, event, order, stage, signals) of one comparison."""
    lines = spark.read.schema("value string, comparison_id int").text(folder).where(F.col("comparison_id") == comparison_id)
    kind = "comparison_id int, event string, `order` int, signals map<string,bigint>, stage string"
    return lines.select(F.from_json("value", kind).alias("l")).select("l.*")
