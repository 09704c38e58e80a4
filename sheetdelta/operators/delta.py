"""From matches to typed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import displacement, mapped_box, shape_equivalent, side, style_equivalent
from ..schema import KIND_ORDER, SIDE, THRESHOLDS, Thresholds
from ..tables import bounded

A, B, T = side("a_"), side("b_"), F.col


def state(prefix: str) -> Column:
    """A side as it was read, for before and after."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in SIDE])


def diff_kinds(th: Thresholds = THRESHOLDS) -> Column:
    """The kinds of change between the sides, in their fixed order."""
    eps = th.exact * F.col("diag")
    tests = {
        "moved": displacement(A, B, T) > eps,
        "geometry": ~shape_equivalent(A, B, T, eps),
        "text": ~A("text_payload").eqNullSafe(B("text_payload")),
        "dimension_value": ~A("dimension_value").eqNullSafe(B("dimension_value")),
        "style": ~style_equivalent(A, B, T),
    }
    return F.filter(F.array(*[F.when(tests[k], F.lit(k)) for k in KIND_ORDER]), lambda k: k.isNotNull())


def delta_id() -> Column:
    ends = [F.coalesce(F.col(c), F.lit("")) for c in ("old_id", "new_id")]
    return F.concat(F.lit("d-"), F.substring(F.sha1(F.concat_ws("|", F.col("change_type"), *ends)), 1, 10))


def compute_deltas(rest: tuple[DataFrame, DataFrame], sheets: DataFrame, matches: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """One row per change: comparison_id, delta_id, change_type, kinds, tier, similarity, old_id, new_id, before, after, and the
    anchor box in the new sheet's frame.  An exact match is no change, so only the sides that the exact tier left (``rest``) are read."""
    s = bounded(sheets.withColumn("diag", F.sqrt(F.col("new_width") ** 2 + F.col("new_height") ** 2)).select("comparison_id", "diag", "tx", "ty", "scale", "rotation"))
    old, new = (df.select("comparison_id", F.col(f"{c}_entity_id").alias(id_), *[f"{c}_{x}" for x in SIDE]) for df, c, id_ in zip(rest, "ab", ("old_id", "new_id")))
    met = matches.where("tier <> 'exact'")
    pairs = met.join(old, ["comparison_id", "old_id"]).join(new, ["comparison_id", "new_id"]).join(s, "comparison_id")
    # Alike but too far away: not a move but one entity gone and another come.
    apart = (F.col("tier") == "learned") & (displacement(A, B, T) > th.split * F.col("diag"))
    pairs = pairs.withColumn("apart", apart)
    kept = pairs.where(~F.col("apart")).withColumn("kinds", diff_kinds(th)).where(F.size("kinds") > 0)
    columns = ["comparison_id", "change_type", "kinds", "tier", "similarity", "old_id", "new_id", "before", "after", "x0", "y0", "x1", "y1"]
    nothing = F.lit(None).cast("string")
    no_state = lambda p: F.lit(None).cast(pairs.select(state(p)).schema[0].dataType)
    modified = kept.select(
        "comparison_id", F.lit("modified").alias("change_type"), "kinds", "tier", "similarity", "old_id", "new_id", state("a_").alias("before"), state("b_").alias("after"), "b_x0", "b_y0", "b_x1", "b_y1"
    )
    alone = lambda df, id_: df.join(met.select("comparison_id", id_), ["comparison_id", id_], "left_anti").unionByName(pairs.where("apart").select(df.columns))
    box = mapped_box(A, T)
    empty = F.array().cast("array<string>")
    gone = alone(old, "old_id").join(s, "comparison_id")
    removed = gone.select("comparison_id", F.lit("removed"), empty, nothing, F.lit(None).cast("double"), "old_id", nothing, state("a_"), no_state("b_"), *box)
    come = alone(new, "new_id")
    added = come.select("comparison_id", F.lit("added"), empty, nothing, F.lit(None).cast("double"), nothing, "new_id", no_state("a_"), state("b_"), "b_x0", "b_y0", "b_x1", "b_y1")
    return modified.toDF(*columns).union(removed.toDF(*columns)).union(added.toDF(*columns)).withColumn("delta_id", delta_id())


REPORT_ORDER = ["change_type", "y0", "x0", "delta_id"]


def violations(deltas: DataFrame) -> DataFrame:
    """Rows that break a rule of their change type; there must be none."""
    b, a, n = F.col("before").isNotNull(), F.col("after").isNotNull(), F.size("kinds")
    ok = (
        F.when(F.col("change_type") == "added", ~b & a & (n == 0))
        .when(F.col("change_type") == "removed", b & ~a & (n == 0))
        .when(F.col("change_type") == "modified", b & a & (n > 0) & F.col("tier").isNotNull())
        .otherwise(F.lit(False))
    )
    return deltas.where(~ok)


def outcomes(sheets: DataFrame, deltas: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """changes_found, no_changes or declined for every comparison, those without any change included."""
    n = deltas.groupBy("comparison_id").agg(F.count("*").alias("n"))
    out = sheets.select("comparison_id").join(n, "comparison_id", "left")
    found = F.when(F.coalesce("n", F.lit(0)) > 0, "changes_found").otherwise("no_changes")
    if registered is not None:
        out = out.join(registered.select("comparison_id", "status"), "comparison_id", "left")
        found = F.when(F.col("status") == "failed", "declined").otherwise(found)
    return out.select("comparison_id", F.coalesce("n", F.lit(0)).cast("long").alias("changes"), found.alias("outcome"))
