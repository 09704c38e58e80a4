"""Readers and writers of the comparison's files; each is a plain Spark source or sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTITY

#: Ground-truth records of one revision.
RECORD = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("semantic", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("text", T.StringType()),
    ]
)
JOB = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "state", "reason", "message")]
    + [T.StructField("page_index", T.IntegerType())]
    + [T.StructField(c, T.TimestampType()) for c in ("created_at", "finished_at", "expires_at")]
    + [T.StructField("stage_timings_ms", T.MapType(T.StringType(), T.DoubleType()))]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record lists (one JSON array per file) with their file name."""
    return spark.read.schema(RECORD).json(path, multiLine=True).withColumn("file", F.input_file_name())


def read_entities(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(ENTITY).format(fmt).load(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files; one that cannot be parsed has a null state and keeps its modification time."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "job.json").option("recursiveFileLookup", "true").load(path)
    job = F.from_json(F.decode("content", "utf-8"), JOB)
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.col("modificationTime").alias("newest_file"), job.alias("job")).select("job_id", "newest_file", "job.*")


def with_names(revisions: DataFrame, names: DataFrame) -> DataFrame:
    """The user's file names (comparison_id, revision, name) in place of the stored ones."""
    return revisions.join(names, ["comparison_id", "revision"], "left").withColumn("source_filename", F.coalesce("name", "source_filename")).drop("name")


def write_by_comparison(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per comparison, so that a report is found by its path."""
    df.repartition("comparison_id").write.partitionBy("comparison_id").mode("overwrite").format(fmt).save(path)


def content_hash(files: DataFrame) -> DataFrame:
    """path and SHA-256 of binary files."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"))
