"""Ranks over a whole table: range buckets, their counts, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order``.  Rows are dealt to ranges of the order, so no task holds more than a range,
    and only the ranges' counts come to the driver.  Rows that are equal in ``order`` share a range: give it a last column that differs."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    offsets, before = [], 0
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    offset = spark.createDataFrame(offsets, "_range int, _before long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offset), "_range").withColumn(rank, F.col("_before") + number).drop("_range", "_before")


#: Rows of a group that one task may number by itself.
ONE_TASK = 1_000_000


def numbered(df: DataFrame, key: str, order: list[Column], out: str = "position", most: int = ONE_TASK) -> DataFrame:
    """``df`` with the rows of each ``key`` numbered from 1 in ``order``.  Where the largest group has proved to have at most ``most`` rows
    a window does it; else all rows are ranked together in ranges, and a key's numbers begin at its first rank."""
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    placed = written(ranked(df, [F.asc(key), *order], "_rank"), "ranked")
    first = placed.groupBy(key).agg(F.min("_rank").alias("_first"))
    return placed.join(first, key).withColumn(out, (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_rank", "_first")
