"""Summaries, figures and tables of a report, all read from the changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import location_bin
from ..functions.numbers import canonical, fixed, signed
from ..functions.text import VALUE, capitalised, collapsed, quoted
from ..schema import THRESHOLDS, Thresholds
from ..tables import bounded, ship, written
from .delta import REPORT_ORDER
from .ranking import numbered


#: A private character that no drawing text begins a number with.
MARK = "\ue000"


def _kinds() -> Column:
    return F.array_join("kinds", ", ")


def summary_lines(deltas: DataFrame) -> DataFrame:
    """(comparison_id, delta_id, text, values_grounded): one sentence per change from a fixed template."""
    here = F.coalesce(F.col("after"), F.col("before"))
    kind, semantic = here["kind"], here["semantic_label"]
    before, after = F.col("before"), F.col("after")
    has_text = F.coalesce(here["text_payload"] != "", F.lit(False))
    has_semantic = F.coalesce(semantic != "", F.lit(False))
    q = lambda c: quoted(c)
    (label_b, ok_lb), (label_a, ok_la) = q(before["label"]), q(after["label"])
    (value_b, ok_vb), (value_a, ok_va) = q(before["dimension_value"]), q(after["dimension_value"])
    (text_b, ok_tb), (text_a, ok_ta) = q(before["text_payload"]), q(after["text_payload"])
    typed = q(semantic)[0]
    sure = F.lit(True)
    cases = [
        ((kind == "dimension") & (F.col("change_type") == "added"), F.concat(F.lit("Dimension "), label_a, F.lit(" = "), value_a, F.lit(" added.")), ok_la & ok_va),
        ((kind == "dimension") & (F.col("change_type") == "removed"), F.concat(F.lit("Dimension "), label_b, F.lit(" = "), value_b, F.lit(" removed.")), ok_lb & ok_vb),
        (
            (kind == "dimension") & F.array_contains("kinds", "dimension_value"),
            F.concat(F.lit("Dimension "), label_a, F.lit(" changed from "), value_b, F.lit(" to "), value_a, F.lit(".")),
            ok_la & ok_vb & ok_va,
        ),
        (kind == "dimension", F.concat(F.lit("Dimension "), label_a, F.lit(" modified ("), _kinds(), F.lit(").")), ok_la),
        (
            (kind == "text") & (F.col("change_type") == "modified") & F.array_contains("kinds", "text"),
            F.concat(F.lit("Text changed from "), text_b, F.lit(" to "), text_a, F.lit(".")),
            ok_tb & ok_ta,
        ),
        ((kind == "text") & (F.col("change_type") == "modified"), F.concat(F.lit("Text "), text_a, F.lit(" modified ("), _kinds(), F.lit(").")), ok_ta),
        ((F.col("change_type") == "added") & has_text, F.concat(F.lit("New "), kind, F.lit(" "), text_a, F.lit(" added.")), sure),
        ((F.col("change_type") == "added") & has_semantic, F.concat(F.lit("New entity added; type "), typed, F.lit(" (inferred).")), sure),
        (F.col("change_type") == "added", F.concat(F.lit("New "), kind, F.lit(" entity added.")), sure),
        ((F.col("change_type") == "removed") & has_text, F.concat(capitalised(kind), F.lit(" "), text_b, F.lit(" removed.")), sure),
        ((F.col("change_type") == "removed") & has_semantic, F.concat(F.lit("Entity removed; type "), typed, F.lit(" (inferred).")), sure),
        (F.col("change_type") == "removed", F.concat(capitalised(kind), F.lit(" entity removed.")), sure),
        (has_semantic, F.concat(F.lit("Entity modified ("), _kinds(), F.lit("); type "), typed, F.lit(" (inferred).")), sure),
    ]
    text = F.concat(F.lit("Entity modified ("), _kinds(), F.lit(")."))
    grounded: Column = sure
    for when, sentence, ok in reversed(cases):
        text = F.when(when, sentence).otherwise(text)
        grounded = F.when(when, ok).otherwise(grounded)
    return deltas.select("comparison_id", "delta_id", collapsed(text).alias("text"), grounded.alias("values_grounded"))


def change_counts(sheets: DataFrame, deltas: DataFrame) -> DataFrame:
    """total, added, removed and modified of every comparison."""
    kinds = ["added", "removed", "modified"]
    n = deltas.groupBy("comparison_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("change_type") == k).alias(k) for k in kinds])
    out = sheets.select("comparison_id").join(n, "comparison_id", "left")
    return out.select("comparison_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["total", *kinds]])


#: Boxes of a tile that are counted together, and how often a fuller tile is cut again.
TILE, CUTS = 256, 8


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of the boxes (x0, y0, x1, y1) of each group.

    Groups are cut into square tiles whose sides are powers of two, so borders are exact.  A box leaves its rim in the tiles that it
    cuts, and for each row of tiles the run of tiles that it covers whole; such tiles count at once and drop what else lies in
    them.  Tiles that still hold over TILE boxes are cut again.  What is left is counted tile by tile, so no task holds a group."""
    b = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(*keys, F.lit("").alias("_tile"), "x0", "y0", "x1", "y1")
    group, areas = [*keys, "_tile"], []
    for _ in range(CUTS):
        b = written(b, "boxes")
        span = b.groupBy(*group).agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
        crowded = span.where(F.col("n") > TILE).select(*group, F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("w", "h") / F.sqrt(F.col("n") * 4 / TILE)))).alias("size"))
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            break
        whole, pieces = _tiles(b.join(crowded, group), group)
        areas.append(whole)
        b = b.join(crowded, group, "left_anti").unionByName(pieces)
    else:
        # Cuts did not part these.
        b, n = written(b, "boxes"), F.col("n") > TILE
        full = written(b.groupBy(*group).agg(F.count("*").alias("n")).where(n).select(*group), "crowded")
        areas.append(_swept(b.join(full, group), group))
        b = b.join(full, group, "left_anti")
    areas.append(_covered(b, group))
    total = areas[0]
    for more in areas[1:]:
        total = total.unionByName(more)
    return total.groupBy(*keys).agg(F.sum("area").alias("area"))


def _tiles(b: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(areas of the tiles covered whole by one box, what boxes leave in the other tiles) of boxes with the size of their tiles."""
    size = F.col("size")
    at = {c: F.floor(F.col(c) / size).cast("long") for c in ("x0", "y0")} | {c: (F.ceil(F.col(c) / size) - 1).cast("long") for c in ("x1", "y1")}
    b = b.withColumns({"i0": at["x0"], "i1": at["x1"], "j0": at["y0"], "j1": at["y1"]})
    row = F.explode(F.sequence("j0", "j1")).alias("j")
    inner = b.where("i1 - i0 > 1 and j1 - j0 > 1").select(*group, "size", F.explode(F.sequence(F.col("j0") + 1, F.col("j1") - 1)).alias("j"), (F.col("i0") + 1).alias("a"), (F.col("i1") - 1).alias("b"))
    before = F.coalesce(F.max("b").over(Window.partitionBy(*group, "j").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.col("a") - 1)
    runs = inner.withColumn("a", F.greatest(F.col("a"), before + 1)).where("a <= b")
    full = written(runs.select(*group, "size", "j", F.explode(F.sequence("a", "b")).alias("i")), "tiles")
    rim = F.when((F.col("j") == F.col("j0")) | (F.col("j") == F.col("j1")), F.sequence("i0", "i1")).otherwise(F.array_distinct(F.array("i0", "i1")))
    pieces = b.select("*", row).withColumn("i", F.explode(rim)).join(full.select(*group, "j", "i"), [*group, "j", "i"], "left_anti")
    low = {"x0": F.greatest(F.col("x0"), F.col("i") * size), "y0": F.greatest(F.col("y0"), F.col("j") * size)}
    high = {"x1": F.least(F.col("x1"), (F.col("i") + 1) * size), "y1": F.least(F.col("y1"), (F.col("j") + 1) * size)}
    tile = F.concat_ws("/", "_tile", F.col("i").cast("string"), F.col("j").cast("string"))
    cut = {c: v.alias(c) for c, v in (low | high).items()}
    # Equal pieces cover what one of them covers.
    pieces = pieces.select(*group[:-1], tile.alias("_tile"), *[cut[c] for c in ("x0", "y0", "x1", "y1")]).distinct()
    return full.groupBy(*group).agg(F.sum(size * size).alias("area")), pieces


def _covered(b: DataFrame, group: list[str]) -> DataFrame:
    """Areas of tiles of at most TILE boxes: their coordinates are the lines of a small grid, whose cells count who covers them."""

    def area(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        (xs, i), (ys, j) = (np.unique(tile[[c + "0", c + "1"]].to_numpy(), return_inverse=True) for c in "xy")
        i, j = i.reshape(-1, 2), j.reshape(-1, 2)
        over = np.zeros((len(xs), len(ys)), np.int32)
        for m, k, by in ((0, 0, 1), (1, 0, -1), (0, 1, -1), (1, 1, 1)):
            np.add.at(over, (i[:, m], j[:, k]), by)
        some = over.cumsum(0).cumsum(1)[:-1, :-1] > 0
        return pd.DataFrame([[*key, float(np.diff(xs) @ (some @ np.diff(ys)))]], columns=[*group, "area"])

    ship(b.sparkSession)
    kinds = dict(b.dtypes)
    return b.groupBy(*group).applyInPandas(area, ", ".join([f"`{k}` {kinds[k]}" for k in group] + ["area double"]))


def _swept(b: DataFrame, group: list[str]) -> DataFrame:
    """Vertical slabs between neighbouring x coordinates: within a slab a box is its y interval, and the union of intervals is a
    running maximum.  A box is repeated per slab that it spans, and no pair of boxes is made."""
    xs = b.select(*group, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    order = Window.partitionBy(*group).orderBy("x")
    slabs = xs.withColumns({"i": F.row_number().over(order), "next": F.lead("x").over(order)})
    low = slabs.select(*group, F.col("x").alias("x0"), F.col("i").alias("i0"))
    high = slabs.select(*group, F.col("x").alias("x1"), F.col("i").alias("i1"))
    spans = b.join(low, [*group, "x0"]).join(high, [*group, "x1"]).select(*group, "y0", "y1", F.explode(F.sequence(F.col("i0"), F.col("i1") - 1)).alias("i"))
    run = Window.partitionBy(*group, "i").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("y1").over(run)
    covered = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(top, F.col("y0"))), F.lit(0.0))
    height = spans.withColumn("h", covered).groupBy(*group, "i").agg(F.sum("h").alias("h"))
    return height.join(slabs, [*group, "i"]).groupBy(*group).agg(F.sum(F.col("h") * (F.col("next") - F.col("x"))).alias("area"))


def severity(sheets: DataFrame, deltas: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """(comparison_id, changes, area, affected_pct, severity)"""
    area = union_area(deltas, ["comparison_id"])
    n = deltas.groupBy("comparison_id").agg(F.count("*").alias("changes"))
    out = sheets.select("comparison_id", (F.col("new_width") * F.col("new_height")).alias("sheet")).join(n, "comparison_id", "left").join(area, "comparison_id", "left")
    out = out.withColumns({"changes": F.coalesce("changes", F.lit(0)).cast("long"), "area": F.coalesce("area", F.lit(0.0))})
    pct = F.when(F.col("sheet") > 0, 100.0 * F.col("area") / F.col("sheet")).otherwise(F.lit(0.0))
    return out.withColumn("affected_pct", pct).select("comparison_id", "changes", "area", "affected_pct", severity_label(F.col("affected_pct"), F.col("changes"), th).alias("severity"))


def severity_label(pct: Column, changes: Column, th: Thresholds = THRESHOLDS) -> Column:
    return (
        F.when((pct >= th.area_high) | (changes >= th.changes_high), "High")
        .when((pct >= th.area_medium) | (changes >= th.changes_medium), "Medium")
        .otherwise("Low")
    )


def _value(s: Column) -> Column:
    return F.coalesce(s["dimension_value"], s["text_payload"], F.lit(""))


def delta_cell() -> Column:
    before, after = F.col("before"), F.col("after")
    b, a = F.coalesce(before["dimension_value"], F.lit("")), F.coalesce(after["dimension_value"], F.lit(""))
    part = lambda v, k: F.regexp_extract(v, VALUE, k)
    same_unit = b.rlike(VALUE) & a.rlike(VALUE) & (part(b, 2) == part(a, 2))
    diff = F.concat_ws(" ", signed(part(a, 1).cast("double") - part(b, 1).cast("double")), part(a, 2))
    dx = (after["x0"] + after["x1"]) / 2 - (before["x0"] + before["x1"]) / 2
    dy = (after["y0"] + after["y1"]) / 2 - (before["y0"] + before["y1"]) / 2
    moved = F.concat(fixed(F.sqrt(dx * dx + dy * dy), 1), F.lit(" pt"))
    both = before.isNotNull() & after.isNotNull()
    return F.when(both & same_unit, diff).when(both & F.array_contains("kinds", "moved"), moved).otherwise(F.lit(""))


def summary_table(sheets: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows of the report's table, in report order (position)."""
    here = F.coalesce(F.col("after"), F.col("before"))
    d = numbered(deltas.join(bounded(sheets.select("comparison_id", "new_width", "new_height")), "comparison_id"), "comparison_id", [F.asc(c) for c in REPORT_ORDER])
    number = F.col("position").cast("string")
    kinds = F.when((F.col("change_type") == "modified") & (F.size("kinds") > 0), F.concat(F.lit(" ("), _kinds(), F.lit(")"))).otherwise(F.lit(""))
    percent = lambda v: F.concat(fixed(v * 100, 0), F.lit("%"))
    return d.select(
        "comparison_id",
        F.col("position").cast("long").alias("position"),
        "delta_id",
        F.concat(F.lit("CH-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("change"),
        F.concat(capitalised(F.col("change_type")), kinds).alias("change_cell"),
        F.when(here["semantic_label"].isNotNull(), F.concat(here["semantic_label"], F.lit(" ("), percent(F.coalesce(here["semantic_confidence"], F.lit(0.0))), F.lit(")")))
        .otherwise(here["kind"])
        .alias("entity"),
        location_bin(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "new_width", "new_height")]).alias("location"),
        _value(F.col("before")).alias("old_value"),
        _value(F.col("after")).alias("new_value"),
        delta_cell().alias("delta"),
        F.when((F.col("tier") == "learned") & F.col("similarity").isNotNull(), percent(F.col("similarity"))).otherwise(F.lit("")).alias("confidence"),
    )


def top_changes(deltas: DataFrame, n: int = 15, types: list[str] | None = None) -> DataFrame:
    """The first n changes of every comparison in report order, of the given types only."""
    d = deltas.where(F.col("change_type").isin(types)) if types else deltas
    # Each task keeps its first n of a comparison before they meet.
    place = F.row_number().over(Window.partitionBy("comparison_id").orderBy(*REPORT_ORDER))
    return d.withColumn("position", place).where(F.col("position") <= n)


def recommendations(severities: DataFrame, counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """(comparison_id, recommendations): the advice that applies, computed from the changes."""
    dims = deltas.where((F.col("change_type") == "modified") & (F.coalesce(F.col("after"), F.col("before"))["kind"] == "dimension")).select("comparison_id").distinct().withColumn("dims", F.lit(True))
    r = severities.join(counts, "comparison_id").join(dims, "comparison_id", "left")
    advice = F.array(
        F.when(F.col("severity") == "High", F.lit("Immediate review: high severity revision.")),
        F.when(F.col("added") > 0, F.concat(F.lit("Verify "), F.col("added").cast("string"), F.lit(" added entities."))),
        F.when(F.col("removed") > 0, F.concat(F.lit("Confirm "), F.col("removed").cast("string"), F.lit(" removals."))),
        F.when(F.coalesce("dims", F.lit(False)), F.lit("Verify dimension readings.")),
    )
    advice = F.filter(advice, lambda s: s.isNotNull())
    return r.select("comparison_id", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Routine check: no critical changes."))).alias("recommendations"))


def markup_annotations(deltas: DataFrame, margin: float = 2.0) -> DataFrame:
    """A rectangle per change for drawing on the new sheet: its box with a margin, and a circle for the heat map."""
    colour = F.when(F.col("change_type") == "added", "green").when(F.col("change_type") == "removed", "red").otherwise("amber")
    return deltas.select(
        "comparison_id",
        "delta_id",
        colour.alias("colour"),
        *[(F.col(c) - margin).alias(c) for c in ("x0", "y0")],
        *[(F.col(c) + margin).alias(c) for c in ("x1", "y1")],
        ((F.col("x0") + F.col("x1")) / 2).alias("cx"),
        ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
    )


def heat_circles(sheets: DataFrame, deltas: DataFrame) -> DataFrame:
    d = deltas.join(bounded(sheets.select("comparison_id", "new_width", "new_height")), "comparison_id")
    radius = F.greatest(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2, 0.015 * F.greatest("new_width", "new_height"))
    return d.select("comparison_id", "delta_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), radius.alias("radius"))


def to_px(x: Column, zoom: float = 2.0, offset: float = 0.0) -> Column:
    """Place on the display image."""
    return x * zoom + offset


def change_values(deltas: DataFrame) -> DataFrame:
    """Per change the value as a list shows it: ``before → after``, or whichever side there is."""
    b, a = F.nullif(_value(F.col("before")), F.lit("")), F.nullif(_value(F.col("after")), F.lit(""))
    both = F.when(b.isNotNull() & a.isNotNull() & (b != a), F.concat(b, F.lit(" → "), a))
    return deltas.select("comparison_id", "delta_id", F.coalesce(both, a, b, F.lit("")).alias("shown"))


def canonical_reports(sheets: DataFrame, deltas: DataFrame, version: str = "1") -> DataFrame:
    """(comparison_id, report): one JSON text per comparison with sorted names, numbers rounded to six decimals and no negative zero."""

    def number(c: Column) -> Column:
        # Marked texts, whose quotes go at the end: the JSON writer would give large numbers exponents.
        return F.concat(F.lit(MARK), canonical(c))

    def entity(s: Column) -> Column:
        fields = {
            "bbox": F.array(*[number(s[c]) for c in ("x0", "y0", "x1", "y1")]), "dimension_value": s["dimension_value"], "entity_id": s["entity_id"], "kind": s["kind"],
            "label": s["label"], "semantic_label": s["semantic_label"], "style": F.struct(s["fill"].alias("fill"), s["stroke"].alias("stroke"), number(s["width"]).alias("width")), "text_payload": s["text_payload"],
        }
        return F.when(s.isNotNull(), F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))

    row = F.struct(
        entity(F.col("after")).alias("after"), F.array(*[number(F.col(c)) for c in ("x0", "y0", "x1", "y1")]).alias("anchor_bbox"), entity(F.col("before")).alias("before"),
        F.col("change_type").alias("change_type"), F.col("delta_id").alias("delta_id"), F.struct(number(F.col("similarity")).alias("similarity"), F.col("tier").alias("tier")).alias("match"),
        F.col("kinds").alias("modification_kinds"),
    )
    lists = deltas.groupBy("comparison_id").agg(F.array_sort(F.collect_list(F.struct(*REPORT_ORDER, row.alias("row")))).alias("rows"))
    out = sheets.select("comparison_id").join(lists, "comparison_id", "left")
    rows = F.transform(F.coalesce("rows", F.expr("array()").cast(lists.schema["rows"].dataType)), lambda r: r["row"])
    outcome = F.when(F.size(rows) > 0, "changes_found").otherwise("no_changes")
    body = F.struct(F.col("comparison_id"), rows.alias("deltas"), outcome.alias("outcome"), F.lit(version).alias("pipeline_version"))
    text = F.regexp_replace(F.to_json(body, {"ignoreNullFields": "false"}), f'"{MARK}([-0-9.e]+)"', "$1")
    return out.select("comparison_id", text.alias("report"))
