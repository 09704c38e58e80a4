"""The whole comparison as one dataflow over many comparisons at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import with_identity
from ..operators.attention import Model, encode_sheets
from ..operators.delta import compute_deltas, outcomes
from ..operators.features import entity_features
from ..operators.match import match_entities
from ..operators.register import anchors, quality, seeded_ransac
from ..schema import THRESHOLDS, Thresholds
from ..tables import written


@dataclass
class Comparison:
    entities: DataFrame
    registrations: DataFrame
    matches: DataFrame
    deltas: DataFrame
    outcomes: DataFrame


def register(entities: DataFrame, sheets: DataFrame, th: Thresholds = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(sheets with their fitted transform, registrations).  Comparisons that cannot be aligned are declined."""
    pairs = written(anchors(entities), "anchors")
    fitted = written(seeded_ransac(pairs, sheets, th), "fitted")
    found = written(quality(pairs, fitted, sheets, th), "registrations")
    size = sheets.select("comparison_id", "old_width", "old_height", "new_width", "new_height")
    ok = found.where("status = 'aligned'").select("comparison_id")
    return written(size.join(fitted, "comparison_id").join(ok, "comparison_id").drop("n"), "sheets"), found


@dataclass
class Matched:
    entities: DataFrame
    sheets: DataFrame
    found: DataFrame | None
    matches: DataFrame
    rest: tuple[DataFrame, DataFrame]


def matched(entities: DataFrame, sheets: DataFrame, vectors: DataFrame | None = None, th: Thresholds = THRESHOLDS, registered: bool = False, encoder: Model | None = None) -> Matched:
    """The flow up to the matches: for who needs no changes, none are worked out.  Arguments as of ``compare``."""
    named = written(with_identity(entities), "entities")
    found = None
    aligned = sheets
    if not registered:
        aligned, found = register(named, sheets, th)
    here = named.join(aligned.select("comparison_id"), "comparison_id", "left_semi")
    if encoder is not None:
        features = written(entity_features(here, aligned, position=False), "features")
        vectors = encode_sheets(here, aligned, features, encoder)
    return Matched(named, aligned, found, *match_entities(here, aligned, vectors, th))


def compare(entities: DataFrame, sheets: DataFrame, vectors: DataFrame | None = None, th: Thresholds = THRESHOLDS, registered: bool = False, encoder: Model | None = None) -> Comparison:
    """``entities`` without names; ``sheets`` with their sizes, and their transforms if ``registered``.  Vectors for the learned tier are
    given, or come from the ``encoder``."""
    m = matched(entities, sheets, vectors, th, registered, encoder)
    deltas = written(compute_deltas(m.rest, m.sheets, m.matches, th), "deltas")
    status = m.found if m.found is not None else sheets.select("comparison_id", F.lit("aligned").alias("status"))
    return Comparison(m.entities, status, m.matches, deltas, outcomes(sheets, deltas, m.found))
