"""Tables of the data model.  All are keyed by comparison_id; one row of ``sheets`` describes a comparison.

entities: comparison_id, revision (old or new), ordinal (source order), kind, geometry, x0, y0, x1, y1, text_payload, label,
dimension_value, stroke, fill, width, anchor_x, anchor_y, semantic_label, semantic_confidence; then signature and entity_id.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the data model.
KINDS = ["linework", "text", "dimension", "symbol", "hatch"]
CHANGE_TYPES = ["added", "removed", "modified"]
KIND_ORDER = ["moved", "geometry", "text", "dimension_value", "style"]
STATES = ["pending", "extracting", "classifying", "registering", "matching", "diffing", "summarizing", "reporting", "done", "failed", "rejected", "declined"]
TERMINAL = ["done", "failed", "rejected", "declined"]

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SEGMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("points", T.ArrayType(POINT))])
ENTITY = T.StructType(
    [
        T.StructField("comparison_id", T.IntegerType()),
        T.StructField("revision", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("geometry", T.ArrayType(SEGMENT)),
        *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")],
        *[T.StructField(c, T.StringType()) for c in ("text_payload", "label", "dimension_value", "stroke", "fill")],
        *[T.StructField(c, T.DoubleType()) for c in ("width", "anchor_x", "anchor_y")],
        T.StructField("semantic_label", T.StringType()),
        T.StructField("semantic_confidence", T.DoubleType()),
    ]
)
SHEET = T.StructType(
    [
        T.StructField("comparison_id", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("old_width", "old_height", "new_width", "new_height", "tx", "ty", "scale", "rotation")],
    ]
)
#: Names of the sides in joined tables.
SIDE = ["entity_id", "kind", "geometry", "x0", "y0", "x1", "y1", "text_payload", "label", "dimension_value", "stroke", "fill", "width", "anchor_x", "anchor_y", "semantic_label", "semantic_confidence"]


from dataclasses import dataclass  # noqa: E402


@dataclass(frozen=True)
class Thresholds:
    """Fractions of the new sheet's diagonal, and severity bounds (fixed values)."""

    exact: float = 0.001
    in_place: float = 0.01
    split: float = 0.20
    inlier: float = 0.005
    similarity: float = 0.30
    iou: float = 0.8
    min_anchors: int = 3
    min_inlier_ratio: float = 0.6
    area_high: float = 15.0
    area_medium: float = 5.0
    changes_high: int = 50
    changes_medium: int = 10


THRESHOLDS = Thresholds()
