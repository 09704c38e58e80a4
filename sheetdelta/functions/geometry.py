"""Geometry as column expressions.  ``a`` and ``b`` give a side's columns by name; ``t`` the transform's (None: identity)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Side = Callable[[str], Column]


def side(prefix: str) -> Side:
    return lambda name: F.col(prefix + name)


def transform_point(x: Column, y: Column, t: Side | None) -> tuple[Column, Column]:
    if t is None:
        return x, y
    c, s = F.cos(t("rotation")), F.sin(t("rotation"))
    return t("scale") * (c * x - s * y) + t("tx"), t("scale") * (s * x + c * y) + t("ty")


def centre(e: Side) -> tuple[Column, Column]:
    return (e("x0") + e("x1")) / 2.0, (e("y0") + e("y1")) / 2.0


def reference_point(e: Side) -> tuple[Column, Column]:
    x, y = centre(e)
    return F.coalesce(e("anchor_x"), x), F.coalesce(e("anchor_y"), y)


def displacement(a: Side, b: Side, t: Side | None) -> Column:
    """Between anchors if both have one, else between centres; the old point is transformed first."""
    both = a("anchor_x").isNotNull() & b("anchor_x").isNotNull()
    (ax, ay), (bx, by) = centre(a), centre(b)
    ox, oy = transform_point(F.when(both, a("anchor_x")).otherwise(ax), F.when(both, a("anchor_y")).otherwise(ay), t)
    dx, dy = F.when(both, b("anchor_x")).otherwise(bx) - ox, F.when(both, b("anchor_y")).otherwise(by) - oy
    return F.sqrt(dx * dx + dy * dy)


def mapped_corners(e: Side, t: Side | None) -> tuple[Column, Column, Column, Column]:
    """The two transformed corners as they come: a turn may put the first behind the second."""
    return (*transform_point(e("x0"), e("y0"), t), *transform_point(e("x1"), e("y1"), t))


def mapped_box(e: Side, t: Side | None) -> tuple[Column, Column, Column, Column]:
    """The box of the two transformed corners."""
    px, py, qx, qy = mapped_corners(e, t)
    return F.least(px, qx), F.least(py, qy), F.greatest(px, qx), F.greatest(py, qy)


def iou(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    w = F.least(p[2], q[2]) - F.greatest(p[0], q[0])
    h = F.least(p[3], q[3]) - F.greatest(p[1], q[1])
    inside = w * h
    union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inside
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(inside / union)


def _relative(geometry: Column) -> Column:
    """Segments with their points relative to the mean of all points."""
    points = F.flatten(F.transform(geometry, lambda s: s["points"]))
    n = F.size(points)
    cx = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["x"]) / n
    cy = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    return F.transform(
        geometry,
        lambda s: F.struct(
            s["kind"].alias("kind"), F.transform(s["points"], lambda p: F.struct((p["x"] - cx).alias("x"), (p["y"] - cy).alias("y"))).alias("points")
        ),
    )


def shape_text(geometry: Column) -> Column:
    """``kind|dx,dy|...`` of all segments, points relative to their mean."""
    return F.array_join(
        F.transform(
            _relative(geometry),
            lambda s: F.concat_ws("|", s["kind"], F.array_join(F.transform(s["points"], lambda p: F.format_string("%.3f,%.3f", p["x"], p["y"])), "|")),
        ),
        "|",
    )


def has_geometry(geometry: Column) -> Column:
    return F.coalesce(F.size(geometry) > 0, F.lit(False))


def shape_equivalent(a: Side, b: Side, t: Side | None, tolerance: Column, texts: tuple[Column, Column] | None = None) -> Column:
    """Equal shapes up to translation; up to scale and rotation within ``tolerance`` if the transform has any.  ``texts``: the sides'
    ``shape_text``, where it was worked out once for a side and not for each pair."""
    some_a, some_b = has_geometry(a("geometry")), has_geometry(b("geometry"))
    text_a, text_b = texts or (shape_text(a("geometry")), shape_text(b("geometry")))
    exact = text_a == text_b
    if t is None:
        same = exact
    else:
        c, s = F.cos(t("rotation")), F.sin(t("rotation"))

        def near(p: Column, q: Column) -> Column:
            x, y = t("scale") * (c * p["x"] - s * p["y"]), t("scale") * (s * p["x"] + c * p["y"])
            return (F.abs(x - q["x"]) <= tolerance) & (F.abs(y - q["y"]) <= tolerance)

        def alike(p: Column, q: Column) -> Column:
            pairs = F.zip_with(p["points"], q["points"], lambda m, n: F.coalesce(near(m, n), F.lit(False)))
            return (p["kind"] == q["kind"]) & (F.size(p["points"]) == F.size(q["points"])) & F.forall(pairs, lambda ok: ok)

        pairs = F.zip_with(_relative(a("geometry")), _relative(b("geometry")), lambda p, q: F.coalesce(alike(p, q), F.lit(False)))
        loose = (F.size(a("geometry")) == F.size(b("geometry"))) & F.forall(pairs, lambda ok: ok)
        same = F.when((t("scale") == 1.0) & (t("rotation") == 0.0), exact).otherwise(loose)
    return F.when(some_a & some_b, same).otherwise((some_a == some_b) & (a("kind") == b("kind")))


def style_equivalent(a: Side, b: Side, t: Side | None) -> Column:
    wa, wb = F.coalesce(a("width"), F.lit(0.0)), F.coalesce(b("width"), F.lit(0.0))
    close = F.abs(wa - wb) <= 1e-6
    if t is not None:
        scaled = wa * t("scale")
        close = close | ((t("scale") != 1.0) & (F.abs(wb - scaled) <= 0.05 * F.greatest(F.abs(wb), F.abs(scaled))))
    return a("stroke").eqNullSafe(b("stroke")) & a("fill").eqNullSafe(b("fill")) & close


def location_bin(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    def third(c: Column, size: Column) -> Column:
        at = F.when(size > 0, F.least(F.greatest((c / size * 3).cast("int"), F.lit(0)), F.lit(2))).otherwise(F.lit(1))
        return at + 1

    rows = F.element_at(F.array(*[F.lit(s) for s in ("upper", "mid", "lower")]), third((y0 + y1) / 2.0, height))
    columns = F.element_at(F.array(*[F.lit(s) for s in ("left", "center", "right")]), third((x0 + x1) / 2.0, width))
    return F.concat_ws(" ", rows, columns)
