"""Content hashes and stable names of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import has_geometry, shape_text


def geometry_signature() -> Column:
    """Sixteen hex digits over kind, style, text and the shape relative to its mean point."""
    head = [F.col("kind"), F.coalesce("stroke", F.lit("")), F.coalesce("fill", F.lit("")), F.format_string("%.3f", F.coalesce("width", F.lit(0.0)))]
    parts = [*head, F.col("text_payload"), F.when(has_geometry(F.col("geometry")), shape_text(F.col("geometry")))]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def shape_signature() -> Column:
    return F.when(has_geometry(F.col("geometry")), F.substring(F.sha1(shape_text(F.col("geometry"))), 1, 16)).otherwise(F.concat(F.lit("kindonly:"), F.col("kind")))


def with_identity(entities: DataFrame) -> DataFrame:
    """Adds signature and entity_id.  Equal entities at one place are numbered in source order."""
    e = entities.withColumn("signature", geometry_signature())
    base = F.substring(F.sha1(F.concat(F.col("signature"), F.lit("@"), F.format_string("%.3f,%.3f", "x0", "y0"))), 1, 12)
    e = e.withColumn("_base", base)
    order = Window.partitionBy("comparison_id", "revision", "_base").orderBy(F.round("y0", 3), F.round("x0", 3), "signature", "ordinal")
    n = F.row_number().over(order) - 1
    name = F.concat(F.lit("e-"), F.col("_base"), F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")))
    return e.withColumn("entity_id", name).drop("_base")
