"""Writing intermediate results, and bounds for broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType


_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir; it goes when the driver ends.
    Where that is unset, a local session gets a temporary folder and any other an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sheetdelta-")
        spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found}/sheetdelta-{sc.applicationId}"
    if own not in _folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(own)
    return own


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` to be broadcast if it is shown to have at most ``most`` rows and ``most_bytes`` bytes, else as it is, so that Spark
    shuffles both sides and splits skewed partitions."""
    if not df.columns:
        return df
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    sizes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in flat] + [F.octet_length(F.to_json(F.struct(f"`{c}`"))) for c in wide]
    size = sum(sizes, F.lit(16 * len(df.columns)))
    n, total = df.limit(most + 1).select(size.cast("long").alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, however the session was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="sheetdelta-")) / f"{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(z.filename)
    _shipped.add(sc.applicationId)
