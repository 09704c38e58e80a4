"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.tables import bounded, shared_dir, ship, written

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where a table of few files or row groups has less than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    return written(df, name)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it proves to have at most ``max_rows`` rows, and bytes in proportion; else as it is, so that
    Spark shuffles both sides and splits skewed partitions.  ``df`` should be materialised: it is counted."""
    return bounded(df, max_rows)


def prepare(spark: SparkSession) -> None:
    """Make jobs independent of how the session was started: Python workers get this package, and adaptive execution with
    its skew-join splitting is on."""
    ship(spark)
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(key, "true") != "true":
            spark.conf.set(key, "true")


def spans_text(spans, kinds: list[str]):
    """Column: ``kind:start:end`` of an array of (start, ord, end), ordered by start then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
