"""Range joins by grid cells: boxes meet as equal keys, so no join compares all pairs of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(low: Column, high: Column, size: Column) -> Column:
    """The numbers of the cells that an interval touches."""
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def with_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: Column) -> DataFrame:
    """One row per touched cell, numbered ``_cx`` and ``_cy``."""
    return df.withColumn("_cx", F.explode(cells(x0, x1, size))).withColumn("_cy", F.explode(cells(y0, y1, size)))


def cell_sizes(entities: DataFrame, keys: list[str], width: Column, height: Column, reach: Column | float = 0.0) -> DataFrame:
    """(keys, cell): a cell size for each group of boxes, given the sheet's size as columns of ``entities``: about two boxes to a
    cell, but no less than the mean box, the reach of a search, or a 4096th of the sheet.  So the pairs that meet in a cell grow
    with the boxes and not with their square."""
    mean = F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    a = entities.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean"), F.max(width).alias("w"), F.max(height).alias("h"), F.max(reach if isinstance(reach, Column) else F.lit(reach)).alias("reach"))
    size = F.greatest(F.sqrt(F.col("w") * F.col("h") * 2 / F.col("n")), F.col("mean"), 2 * F.col("reach"), F.greatest("w", "h") / 4096, F.lit(1e-6))
    return a.select(*keys, size.alias("cell"))
