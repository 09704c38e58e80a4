"""Generated sheets with known changes: presets as entity tables, mutations and export perturbations as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY, SHEET

WIDTH, HEIGHT = 842.0, 595.0
MUTATIONS = ["dim-change", "add", "remove", "move", "text-edit", "style", "twin", "dim-grow", "dim-change-move"]


def _row(k, kind, box, text=None, label=None, value=None, width=1.0):
    x0, y0, x1, y1 = map(float, box)
    shape = [("rect" if width != 0.8 else "line", [(x0, y0), (x1, y1)])] if kind == "linework" else []
    anchor = (x0, y1) if kind != "linework" else (None, None)
    return (0, "old", k, kind, shape, x0, y0, x1, y1, text, label, value, "#000000", None, width, *anchor, None, None)


def plan(spark: SparkSession) -> DataFrame:
    """A small floor plan: an outer wall, rooms, furniture, room names and four dimensions."""
    rows = [_row(0, "linework", (60, 60, 780, 540), width=2.0)]
    rows += [_row(1 + i, "linework", (x, 60, x, 390 + 7 * i), width=1.2) for i, x in enumerate((240, 420, 600))]
    rows += [_row(4 + i, "linework", (110 + 180 * i, 120, 170 + 180 * i, 160 + 6 * i)) for i in range(4)]
    rows += [_row(8 + i, "linework", (150 + 180 * i, 350, 174 + 180 * i, 374 + i), width=0.8) for i in range(4)]
    for i, t in enumerate(("KITCHEN", "HALL", "STUDY", "BATH", "NOTE: ALL SIZES IN CM", "SHEET A-01")):
        rows.append(_row(20 + i, "text", (100 + 110 * i, 440, 100 + 110 * i + 6 * len(t), 450), text=t, width=10.0))
    for i, v in enumerate((450, 300, 220, 810)):
        t = f"W{i} = {v} cm"
        rows.append(_row(30 + i, "dimension", (100 + 180 * i, 560, 100 + 180 * i + 6 * len(t), 570), text=t, label=f"W{i}", value=f"{v} cm", width=10.0))
    return spark.createDataFrame(rows, ENTITY)


def dense(spark: SparkSession, n: int = 10_000, seed: int = 7) -> DataFrame:
    """``n`` short lines at places drawn by hashing their number; built where the rows are."""
    def draw(salt: int, modulus: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed * 31 + salt)), F.lit(modulus)).cast("double")

    x, y = draw(1, 3_200) / 4 + 10, draw(2, 2_200) / 4 + 10
    w, h = draw(3, 80) / 4 + 1, draw(4, 80) / 4 + 1
    d = spark.range(n).withColumns({"x0": x, "y0": y})
    d = d.withColumns({"x1": F.col("x0") + w, "y1": F.col("y0") + h})
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    values = {
        "comparison_id": F.lit(0), "revision": F.lit("old"), "ordinal": F.col("id"), "kind": F.lit("linework"), "stroke": F.lit("#000000"), "width": F.lit(1.0),
        "geometry": F.array(F.struct(F.lit("line").alias("kind"), F.array(point("x0", "y0"), point("x1", "y1")).alias("points"))),
    }
    d = d.withColumns(values)
    return d.select(*[(F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITY.fields])


def shifted(e: DataFrame, hit: Column, dx: Column | float, dy: Column | float = 0.0, scale: float = 1.0) -> DataFrame:
    """Rows for which ``hit`` holds, scaled and moved with all their points."""
    dx, dy = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (dx, dy))
    at = lambda c, d: F.when(hit, F.col(c) * scale + d).otherwise(F.col(c)).alias(c)
    geometry = F.transform(
        "geometry",
        lambda s: F.struct(s["kind"].alias("kind"), F.transform(s["points"], lambda p: F.struct((p["x"] * scale + dx).alias("x"), (p["y"] * scale + dy).alias("y"))).alias("points")),
    )
    new = {c: at(c, dx if "x" in c.replace("box", "") else dy) for c in ("x0", "x1", "anchor_x", "y0", "y1", "anchor_y")}
    new |= {"geometry": F.when(hit, geometry).otherwise(F.col("geometry"))}
    if scale != 1.0:
        new["width"] = F.when(hit, F.col("width") * scale).otherwise(F.col("width"))
    return e.select(*[new.get(c, F.col(c)).alias(c) for c in e.columns])


def _revalued(e: DataFrame, hit: Column, value: str) -> DataFrame:
    return e.withColumns(
        {
            "text_payload": F.when(hit, F.concat(F.col("label"), F.lit(f" = {value}"))).otherwise(F.col("text_payload")),
            "dimension_value": F.when(hit, F.lit(value)).otherwise(F.col("dimension_value")),
        }
    )


def mutate(old: DataFrame, mutations: list[str], distance: float = 60.0) -> DataFrame:
    """The new revision of ``plan`` after the named changes."""
    e = old.withColumn("revision", F.lit("new"))
    k = F.col("ordinal")
    for m in mutations:
        if m == "dim-change":
            e = _revalued(e, k == 30, "40 cm")
        elif m == "dim-grow":
            e = _revalued(e, k == 33, "10000 cm")
        elif m == "dim-change-move":
            e = shifted(_revalued(e, k == 31, "55 cm"), k == 31, 3.0)
        elif m == "add":
            e = e.union(e.sparkSession.createDataFrame([_row(90, "linework", (700, 120, 750, 170), width=1.2)], ENTITY).withColumn("revision", F.lit("new")))
        elif m == "remove":
            e = e.where(k != 8)
        elif m == "move":
            e = shifted(e, k == 4, distance)
        elif m == "twin":
            e = shifted(e, k == 5, 100.0, 250.0)
        elif m == "text-edit":
            e = e.withColumn("text_payload", F.when(k == 24, F.lit("NOTE: ALL SIZES IN MM")).otherwise(F.col("text_payload")))
        elif m == "style":
            e = e.withColumn("width", F.when(k == 6, F.col("width") + 1.0).otherwise(F.col("width")))
        else:
            raise ValueError(f"no mutation {m!r}; there are {MUTATIONS}")
    return e


def exported(new: DataFrame, dx: float = 0.0, dy: float = 0.0, scale: float = 1.0, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """The new revision as another export places it; nothing may leave the page."""
    e = shifted(new, F.lit(True), dx, dy, scale)
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= width) & (F.col("y1") <= height)
    return e.where(F.when(inside, True).otherwise(F.raise_error(F.lit("an entity leaves the page")).cast("boolean")))


def pair(spark: SparkSession, mutations: list[str], dx: float = 0.0, dy: float = 0.0, scale: float = 1.0, comparison_id: int = 0, distance: float = 60.0) -> DataFrame:
    old = plan(spark)
    both = old.union(exported(mutate(old, mutations, distance), dx, dy, scale))
    return both.withColumn("comparison_id", F.lit(comparison_id))


def sheets(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, WIDTH, HEIGHT, WIDTH, HEIGHT, 0.0, 0.0, 1.0, 0.0) for i in ids], SHEET)


#: What the entities of ``plan`` and ``site`` are, by ordinal.
SEMANTICS = (
    {k: "wall" for k in range(4)} | {k: "furniture" for k in range(4, 8)} | {k: "door" for k in range(8, 12)} | {k: "room-label" for k in range(20, 24)} | {24: "note", 25: "title"}
    | {k: "dimension" for k in range(30, 34)} | {k: "linework" for k in range(50, 59)} | {60: "title", 61: "dimension", 90: "wall", 95: "furniture"}
)


def site(spark: SparkSession) -> DataFrame:
    """A plot of land: its boundary, contours, a title and the length of its front."""
    rows = [_row(50 + i, "linework", box, width=0.8) for i, box in enumerate([(100, 100, 700, 100), (700, 100, 700, 480), (100, 480, 700, 480), (100, 100, 100, 480)])]
    rows += [_row(54 + i, "linework", (140, 150 + 60 * i, 660, 158 + 61 * i), width=0.8) for i in range(5)]
    rows.append(_row(60, "text", (120, 510, 260, 524), text="SITE PLAN B-07", width=14.0))
    rows.append(_row(61, "dimension", (360, 500, 440, 510), text="F = 6000 cm", label="F", value="6000 cm", width=10.0))
    return spark.createDataFrame(rows, ENTITY)


def unrelated(spark: SparkSession, seed: int = 3) -> DataFrame:
    """Twenty lines and a text that no plan has."""
    import random

    r = random.Random(seed)
    rows = []
    for k in range(20):
        x, y = r.uniform(40, 600), r.uniform(40, 420)
        rows.append(_row(100 + k, "linework", (x, y, x + r.uniform(30, 200), y + r.uniform(10, 140)), width=0.8))
    rows.append(_row(120, "text", (300, 560, 420, 572), text="ANOTHER DRAWING", width=12.0))
    return spark.createDataFrame(rows, ENTITY)


PRESETS = {"plan": plan, "dense": dense, "site": site, "unrelated": unrelated}


def learning_pairs(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """Revision pairs of plans, a comparison for each seed, with ``uid`` (an entity's name in both revisions) and ``semantic``.

    A seed moves every entity of the plan a little.  Odd seeds change a value, a text and a style, remove one, add one and move one; even
    seeds change a value, move one, and replace one by a twin of the same shape elsewhere, which is another entity."""
    by_seed = F.explode(F.array(*[F.lit(int(s)) for s in seeds]))
    old = plan(spark).withColumn("comparison_id", by_seed)
    draw = lambda salt: (F.pmod(F.xxhash64("comparison_id", "ordinal", F.lit(salt)), F.lit(33)) - 16).cast("double") / 4
    old = shifted(old, F.lit(True), draw(1), draw(2))
    seed = F.col("comparison_id")
    step = 10.0 * (seed % 5 + 1)
    odd, even = old.where(seed % 2 == 1), old.where(seed % 2 == 0)
    new = mutate(odd, ["dim-change", "remove", "move", "text-edit", "style"], step).union(mutate(even, ["dim-change", "move", "twin"], step))
    added = spark.createDataFrame([_row(90, "linework", (700, 120, 750, 170), width=1.2)], ENTITY).withColumns({"revision": F.lit("new"), "comparison_id": by_seed}).where(seed % 2 == 1)
    both = old.union(new).union(added)
    twin = (F.col("revision") == "new") & (seed % 2 == 0) & (F.col("ordinal") == 5)
    uid = F.when(twin, F.lit(95)).otherwise(F.col("ordinal"))
    known = F.create_map(*[F.lit(v) for pair_ in SEMANTICS.items() for v in pair_])
    return both.withColumns({"uid": uid.cast("string"), "semantic": F.element_at(known, F.col("ordinal").cast("int"))})
