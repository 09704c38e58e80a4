"""Drawing sheets derived from the ``part`` table, by SQL that both engines read: two revisions of seven sheets with known changes.

All coordinates are multiples of a quarter, so decimals are exact.  Rules of the new revision, the first that applies: every 17th
part is removed, every 19th moved by 20, every 23rd dimension changed, every 29th restyled; every 31st is added again further down.
Odd sheets are shifted by (8, -4), sheet 6 is exported at scale 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEETS_SQL = """
SELECT CAST(c AS INT) AS comparison_id, CAST(842 AS DOUBLE) AS old_width, CAST(595 AS DOUBLE) AS old_height,
  CAST(CASE WHEN c = 6 THEN 1684 ELSE 842 END AS DOUBLE) AS new_width, CAST(CASE WHEN c = 6 THEN 1190 ELSE 595 END AS DOUBLE) AS new_height,
  CAST(CASE WHEN c % 2 = 1 THEN 8 ELSE 0 END AS DOUBLE) AS tx, CAST(CASE WHEN c % 2 = 1 THEN -4 ELSE 0 END AS DOUBLE) AS ty,
  CAST(CASE WHEN c = 6 THEN 2 ELSE 1 END AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS rotation
FROM (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) numbers
"""

_BASE = """
SELECT p_partkey AS k, p_size AS size, CAST(p_partkey % 7 AS INT) AS comparison_id,
  CASE WHEN p_partkey % 4 < 2 THEN 'linework' WHEN p_partkey % 4 = 2 THEN 'text' ELSE 'dimension' END AS kind,
  CAST((p_partkey * 37) % 3000 AS DOUBLE) / CAST(4 AS DOUBLE) AS bx, CAST((p_partkey * 91) % 2200 AS DOUBLE) / CAST(4 AS DOUBLE) AS yy,
  CAST(4 + p_partkey % 20 AS DOUBLE) AS w, CAST(4 + p_partkey % 12 AS DOUBLE) AS h,
  CAST(2 + p_partkey % 3 AS DOUBLE) / CAST(2 AS DOUBLE) AS sw
FROM part
"""

#: rows: comparison_id, revision, ordinal, kind, x0, y0, x1, y1, name, value (of a dimension), width
_PLACED = f"""
SELECT comparison_id, 'old' AS revision, k * 2 AS ordinal, kind, bx AS x0, yy AS y0, bx + w AS x1, yy + h AS y1, concat('', k) AS name, size AS value, sw AS width FROM ({_BASE}) b
UNION ALL
SELECT comparison_id, 'new', k * 2, kind, (x + tx) * f, (yy + ty) * f, (x + w + tx) * f, (yy + h + ty) * f, concat('', k), value, width * f FROM (
  SELECT *, CASE WHEN k % 19 = 0 THEN bx + CAST(20 AS DOUBLE) ELSE bx END AS x,
    CASE WHEN k % 19 <> 0 AND k % 23 = 0 AND kind = 'dimension' THEN size + 1 ELSE size END AS value,
    CASE WHEN k % 19 <> 0 AND NOT (k % 23 = 0 AND kind = 'dimension') AND k % 29 = 0 THEN sw + CAST(1 AS DOUBLE) ELSE sw END AS width,
    CAST(CASE WHEN comparison_id % 2 = 1 THEN 8 ELSE 0 END AS DOUBLE) AS tx, CAST(CASE WHEN comparison_id % 2 = 1 THEN -4 ELSE 0 END AS DOUBLE) AS ty,
    CAST(CASE WHEN comparison_id = 6 THEN 2 ELSE 1 END AS DOUBLE) AS f
  FROM ({_BASE}) b WHERE k % 17 <> 0) n
UNION ALL
SELECT comparison_id, 'new', k * 2 + 1, kind, (bx + tx) * f, (y + ty) * f, (bx + w + tx) * f, (y + h + ty) * f, concat('A', k), size, sw * f FROM (
  SELECT *, yy + CAST(300 AS DOUBLE) AS y, CAST(CASE WHEN comparison_id % 2 = 1 THEN 8 ELSE 0 END AS DOUBLE) AS tx,
    CAST(CASE WHEN comparison_id % 2 = 1 THEN -4 ELSE 0 END AS DOUBLE) AS ty, CAST(CASE WHEN comparison_id = 6 THEN 2 ELSE 1 END AS DOUBLE) AS f
  FROM ({_BASE}) b WHERE k % 31 = 0) a
"""

ENTITIES_SQL = f"""
SELECT comparison_id, revision, ordinal, kind, x0, y0, x1, y1,
  CASE WHEN kind = 'text' THEN concat('N', name) WHEN kind = 'dimension' THEN concat('D', name, ' = ', value, ' cm') END AS text_payload,
  CASE WHEN kind = 'dimension' THEN concat('D', name) END AS label, CASE WHEN kind = 'dimension' THEN concat(value, ' cm') END AS dimension_value,
  '#000000' AS stroke, CAST(NULL AS VARCHAR(8)) AS fill, width,
  CASE WHEN kind <> 'linework' THEN x0 END AS anchor_x, CASE WHEN kind <> 'linework' THEN y1 END AS anchor_y
FROM ({_PLACED}) p
"""


def sheets(spark: SparkSession) -> DataFrame:
    return spark.sql(SHEETS_SQL)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of both revisions; linework is a rectangle, texts have no geometry."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    # A small file is few tasks, and an entity is far more work than its row is bytes.
    part = part.repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    e = spark.sql(f"WITH part AS (SELECT * FROM {{part}}) {ENTITIES_SQL}", part=part)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rect = F.array(F.struct(F.lit("rect").alias("kind"), F.array(point("x0", "y0"), point("x1", "y1")).alias("points")))
    geometry = F.when(F.col("kind") == "linework", rect).otherwise(F.expr("cast(array() as array<struct<kind:string,points:array<struct<x:double,y:double>>>>)"))
    return e.withColumns({"geometry": geometry, "semantic_label": F.lit(None).cast("string"), "semantic_confidence": F.lit(None).cast("double")})
