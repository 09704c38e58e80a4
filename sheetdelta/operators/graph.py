"""Edges between the entities of a sheet: nearest neighbours, touching boxes, and their union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import bounded, written
from .grid import cell_sizes, with_cells

KEY = ["comparison_id", "revision"]
K = 4


#: Nodes of a cell that are compared in one piece.
CROWD = 2_048

#: Levels of the quadtree, and the most entities of a cell before it is split.
LEVELS, FULL = 44, 16


def _at(level: str, g: str) -> Column:
    """The number of the cell at a level, from that at the deepest one."""
    return F.expr(f"shiftright({g}, {LEVELS} - {level})")


def quadtree(entities: DataFrame) -> DataFrame:
    """(KEY, entity_id, cx, cy, gx, gy, level, extent): every entity's centre, its deepest cell, and the level of its leaf.

    A sheet begins at the level with two to eight entities to a cell on average.  Cells with over FULL entities are split: the entities
    in them count in the cells of all deeper levels at once, and end below the last one that is still full."""
    e = entities.select(*KEY, "entity_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    span = e.groupBy(*KEY).agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in ("cx", "cy") for p, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(F.col("hicx") - F.col("locx"), F.col("hicy") - F.col("locy"), F.lit(1e-9))
    first = F.least(F.greatest(F.floor(F.log(F.col("n") / 2) / F.log(F.lit(4.0))), F.lit(0)), F.lit(LEVELS)).cast("int")
    e = e.join(bounded(written(span.select(*KEY, "locx", "locy", extent.alias("extent"), first.alias("level")), "spans")), KEY)
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("extent") * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("long")
    e = written(e.select(*KEY, "entity_id", "cx", "cy", cell("cx", "locx").alias("gx"), cell("cy", "locy").alias("gy"), "level", "extent"), "centres")
    place = [*KEY, "level", _at("level", "gx").alias("x"), _at("level", "gy").alias("y")]
    full = written(e.select(*place).groupBy(*KEY, "level", "x", "y").count().where(F.col("count") > FULL), "full")
    if full.isEmpty():
        return e
    here = [*KEY, "level", "x", "y"]
    crowded = e.select(*place, "entity_id", "gx", "gy").join(full, here, "left_semi").select(*KEY, "entity_id", "gx", "gy", F.explode(F.sequence(F.col("level"), F.lit(LEVELS))).alias("level"))
    crowded = crowded.select(*place, "entity_id")
    full = crowded.groupBy(*here).count().where(F.col("count") > FULL)
    below = crowded.join(full, here).groupBy(*KEY, "entity_id").agg(F.max("level").alias("deep"))
    level = F.coalesce(F.least(F.col("deep") + 1, F.lit(LEVELS)), F.col("level"))
    return written(e.join(below, [*KEY, "entity_id"], "left").withColumn("level", level).drop("deep"), "leaves")


def knn(entities: DataFrame, k: int = K) -> DataFrame:
    """(comparison_id, revision, entity_id, other_id, distance, rank): the k nearest other entities by centre, ties by name.

    An entity meets those in the three by three cells around it, at the level of its leaf in the sheet's quadtree.  They hold every
    entity nearer than a cell's size; entities whose k-th neighbour is not that near look again in larger cells, until one cell
    covers the sheet.  So a dense cluster is searched in small cells and a far entity in large ones.  Of entities with one centre only
    the first k + 1 by name can be anyone's neighbours, so a heap of equal centres is not compared with itself."""
    open_ = quadtree(entities)
    same = Window.partitionBy(*KEY, "cx", "cy").orderBy("entity_id")
    points = open_.select(*KEY, "entity_id", "cx", "cy", "gx", "gy").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    points = written(points.select(*KEY, F.col("entity_id").alias("other_id"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), "gx", "gy"), "points")
    found = None
    while True:
        levels = F.array(*[F.lit(r.level) for r in open_.select("level").distinct().collect()])  # LEVELS + 1 at most
        others = points.withColumn("level", F.explode(levels)).select(*KEY, "level", _at("level", "gx").alias("x"), _at("level", "gy").alias("y"), "other_id", "ox", "oy")
        near_cells = lambda g: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _at("level", g) + d))
        around = open_.select(*KEY, "level", "entity_id", "cx", "cy", "gy", near_cells("gx").alias("x")).withColumn("y", near_cells("gy")).drop("gy")
        pairs = around.join(others, [*KEY, "level", "x", "y"]).where(F.col("entity_id") != F.col("other_id"))
        dx, dy = F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy")
        pairs = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy))
        order = Window.partitionBy(*KEY, "entity_id").orderBy("distance", "other_id")
        near = written(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*KEY, "entity_id", "other_id", "distance", "rank"), "near")
        last = near.groupBy(*KEY, "entity_id").agg(F.max("distance").alias("far"), F.count("*").alias("got"))
        size = F.col("extent") / F.pow(F.lit(2.0), F.col("level"))
        # Cell borders are rounded; a hair less than their size is sure.
        sure = (F.col("got") == k) & (F.col("far") < size * (1 - 1e-6)) | (F.col("level") == 0)
        # With k neighbours the level whose cells are larger than the last one's distance is known; with fewer, cells grow fourfold.
        reach = F.floor(F.log2(F.col("extent") / F.greatest(F.col("far") * 1.01, F.col("extent") / (1 << LEVELS)))).cast("int")
        up = F.when(F.col("got") == k, F.least(reach, F.col("level") - 1)).otherwise(F.col("level") - 2)
        state = open_.join(last, [*KEY, "entity_id"], "left").select(*open_.columns, F.coalesce(sure, F.lit(False)).alias("sure"), F.greatest(F.coalesce(up, F.col("level") - 2), F.lit(0)).alias("up"))
        state = written(state, "rings")
        now = near.join(state.where("sure").select(*KEY, "entity_id"), [*KEY, "entity_id"], "left_semi")
        found = now if found is None else found.union(now)
        open_ = state.where("not sure").drop("sure", "level").withColumnRenamed("up", "level")
        if open_.isEmpty():
            return found


def knn_edges(entities: DataFrame, k: int = K) -> DataFrame:
    n = knn(entities, k)
    return n.select(*KEY, F.least("entity_id", "other_id").alias("source"), F.greatest("entity_id", "other_id").alias("target")).distinct().withColumn("edge_kind", F.lit("knn-proximity"))


BOX = ["x0", "y0", "x1", "y1"]


def placed(boxes: DataFrame, sheets: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """``boxes`` (KEY, BOX, ...) with their tolerance, a share of their own sheet's diagonal, and their sheet's cell size."""
    own = lambda c: F.when(F.col("revision") == "old", F.col("old_" + c)).otherwise(F.col("new_" + c))
    sizes = ["old_width", "old_height", "new_width", "new_height"]
    e = boxes.join(bounded(sheets.select("comparison_id", *sizes)), "comparison_id")
    e = e.withColumns({"_w": own("width"), "_h": own("height")}).drop(*sizes).withColumn("tol", F.sqrt(F.col("_w") ** 2 + F.col("_h") ** 2) * tolerance)
    cells = bounded(written(cell_sizes(e, KEY, F.col("_w"), F.col("_h"), F.col("tol")), "cells"))
    return e.drop("_w", "_h").join(cells, KEY)


def in_cells(boxes: DataFrame) -> DataFrame:
    """A row for every cell that a box of ``placed`` touches."""
    tol = F.col("tol")
    return with_cells(boxes, F.col("x0") - tol, F.col("y0") - tol, F.col("x1") + tol, F.col("y1") + tol, F.col("cell"))


def meeting(a: DataFrame, b: DataFrame, rule: Column) -> DataFrame:
    """Pairs of rows of ``in_cells`` that touch and fit ``rule``, each once; the box of ``b`` has names with an o before them."""
    pairs = a.join(b, [*KEY, "_cx", "_cy"]).where(rule)
    # Boxes that share several cells count in the first of them, where the later of their lower corners lies.
    first = [F.floor((F.greatest(F.col(c), F.col("o" + c)) - F.col("tol")) / F.col("cell")) == F.col(g) for c, g in (("x0", "_cx"), ("y0", "_cy"))]
    return pairs.where(touching() & first[0] & first[1])


def touching() -> Column:
    tol = F.col("tol")
    return (F.col("ox0") <= F.col("x1") + tol) & (F.col("ox1") >= F.col("x0") - tol) & (F.col("oy0") <= F.col("y1") + tol) & (F.col("oy1") >= F.col("y0") - tol)


def _other(boxes: DataFrame, name: str, *columns: str) -> DataFrame:
    """The second side of ``meeting``."""
    return boxes.select(*KEY, "_cx", "_cy", F.col("entity_id").alias(name), *[F.col(c).alias("o" + c) for c in BOX], *columns)


def touch_edges(entities: DataFrame, sheets: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Pairs of entities whose boxes, widened by a share of their own sheet's diagonal, overlap."""
    e = in_cells(placed(entities.select(*KEY, "entity_id", *BOX), sheets, tolerance))
    pairs = meeting(e.withColumnRenamed("entity_id", "source"), _other(e, "target"), F.col("source") < F.col("target"))
    return pairs.select(*KEY, "source", "target", F.lit("connectivity").alias("edge_kind"))


def graph_edges(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Both kinds of edges.  Each kind has a pair once and the kind is a column, so nothing is left to be made distinct."""
    return knn_edges(entities).unionByName(touch_edges(entities, sheets))


def alike(boxes: DataFrame, *values: str) -> DataFrame:
    """(KEY, BOX, values, entity_id, n): rows with equal boxes and values as one, under the lowest of their names."""
    return boxes.groupBy(*KEY, *BOX, *values).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))


def touching_groups(groups: DataFrame, sheets: DataFrame, *values: str, tolerance: float = 0.001) -> DataFrame:
    """(KEY, target, source, n, values): the groups of ``alike`` that each group touches, itself among them, with their sizes and values;
    in ``n`` a member does not count itself.  Copies are counted, never paired, and pairs need no shuffle before they are added up."""
    e = in_cells(placed(groups, sheets, tolerance))
    pairs = meeting(e.withColumnRenamed("entity_id", "source"), _other(e, "target"), F.lit(True))
    return pairs.select(*KEY, "target", "source", (F.col("n") - (F.col("source") == F.col("target")).cast("int")).alias("n"), *values)


def touch_degrees(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """``degrees`` of ``touch_edges``, without the edges: equal boxes have equal degrees."""
    e = entities.select(*KEY, "entity_id", *BOX)
    groups = written(alike(e), "boxes")
    degree = touching_groups(groups, sheets).groupBy(*KEY, F.col("target").alias("entity_id")).agg(F.sum("n").alias("degree")).where("degree > 0")
    return e.join(groups.join(degree, [*KEY, "entity_id"]).drop("entity_id"), [*KEY, *BOX]).select(*KEY, "entity_id", "degree")


def both_directions(edges: DataFrame) -> DataFrame:
    """Directed (source, target) pairs both ways, each once."""
    back = edges.select(*KEY, F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.select(*KEY, "source", "target").union(back).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy(*KEY, F.col("source").alias("entity_id")).agg(F.count("*").alias("degree"))


@dataclass
class SheetGraph:
    """``graph_edges`` both ways, and everyone with themselves, without a row for each pair.  Entities with equal boxes and inputs whose
    nearest neighbours all touch them hear the same: they are one node with a number.  Touching nodes are found on cells whenever they
    are needed, and added up there (``cells``, or as ``pairs``); only edges to a neighbour that does not touch lie in a table."""

    nodes: DataFrame  # KEY, BOX, tol, cell, x (inputs), entity_id (the node's name), n
    members: DataFrame  # KEY, entity_id, node
    apart: DataFrame  # KEY, source, target: between nodes of one entity
    full: DataFrame  # KEY, _cx, _cy, _parts: cells with over CROWD nodes, and the parts in which they are dealt out

    def pairs(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(KEY, source, target, n, columns of both): who hears whom, with the number of the source's members."""
        boxes = self.nodes.drop("x")
        a = in_cells(boxes.withColumnRenamed("entity_id", "source").join(sources, [*KEY, "source"]))
        more = [c for c in targets.columns if c not in (*KEY, "target")]
        b = _other(in_cells(boxes.drop("n").join(targets.withColumnRenamed("target", "entity_id"), [*KEY, "entity_id"])), "target", *more)
        apart = self.apart.join(sources, [*KEY, "source"]).join(targets, [*KEY, "target"]).withColumn("n", F.lit(1).cast("long"))
        return meeting(a, b, F.lit(True)).select(*apart.columns).union(apart)

    def cells(self, values: DataFrame) -> DataFrame:
        """The boxes of the nodes with their ``values`` (KEY, entity_id, ...) in each cell that they touch.  Of a full cell each part meets
        each: ``_i`` and ``_j`` are the parts of targets and sources; a row of ``_part`` 1 is a target only and one of 2 a source only."""
        rows = in_cells(self.nodes.drop("x").join(values, [*KEY, "entity_id"]))
        zero = F.lit(0)
        alone = {"_i": zero, "_j": zero, "_part": zero}
        if self.full.isEmpty():
            return rows.withColumns(alone)
        here = [*KEY, "_cx", "_cy"]
        full = bounded(self.full)
        dealt = rows.join(full, here).withColumns({"_own": F.pmod(F.xxhash64("entity_id"), F.col("_parts")).cast("int"), "_other": F.explode(F.sequence(zero, F.col("_parts") - 1))})
        as_target = dealt.withColumns({"_i": F.col("_own"), "_j": F.col("_other"), "_part": F.lit(1)})
        as_source = dealt.withColumns({"_i": F.col("_other"), "_j": F.col("_own"), "_part": F.lit(2)})
        return rows.join(full, here, "left_anti").withColumns(alone).unionByName(as_target.union(as_source).drop("_own", "_other", "_parts"))

    def inputs(self) -> DataFrame:
        return self.nodes.select(*KEY, "entity_id", "x")

    def spread(self, found: DataFrame) -> DataFrame:
        """What was found for nodes, for every entity."""
        return self.members.join(found.withColumnRenamed("entity_id", "node"), [*KEY, "node"]).drop("node")


def sheet_graph(entities: DataFrame, sheets: DataFrame, inputs: DataFrame, tolerance: float = 0.001, k: int = K) -> SheetGraph:
    """The graph of ``entities`` with their ``inputs`` (KEY, entity_id, x: an array)."""
    e = entities.select(*KEY, "entity_id", *BOX).join(inputs, [*KEY, "entity_id"])
    e = written(placed(e, sheets, tolerance), "placed")
    boxes = e.select(*KEY, "entity_id", *BOX, "tol")
    other = lambda name: boxes.select(*KEY, F.col("entity_id").alias(name), *[F.col(c).alias("o" + c) for c in BOX])
    not_touching = ~F.coalesce(touching(), F.lit(False))
    near = knn_edges(entities, k).join(boxes.withColumnRenamed("entity_id", "source"), [*KEY, "source"]).join(other("target"), [*KEY, "target"]).where(not_touching)
    # A box with its corners the wrong way round does not touch itself.
    own = boxes.select(*KEY, F.col("entity_id").alias("source"), F.col("entity_id").alias("target"), *BOX, *[F.col(c).alias("o" + c) for c in BOX], "tol").where(not_touching)
    apart = written(both_directions(near.select(*KEY, "source", "target").union(own.select(*KEY, "source", "target"))), "apart")
    single = apart.select(*KEY, F.col("source").alias("entity_id")).distinct()
    alone = e.join(single, [*KEY, "entity_id"], "left_semi")
    rest = written(e.join(single, [*KEY, "entity_id"], "left_anti"), "rest")
    groups = written(alike(rest, "tol", "cell", "x"), "groups")
    nodes = alone.withColumn("n", F.lit(1).cast("long")).unionByName(groups)
    members = rest.join(groups.select(*KEY, *BOX, "x", F.col("entity_id").alias("node")), [*KEY, *BOX, "x"]).select(*KEY, "entity_id", "node")
    nodes = written(nodes, "nodes")
    parts = F.ceil(F.col("count") / CROWD).cast("int").alias("_parts")
    full = in_cells(nodes.drop("x")).groupBy(*KEY, "_cx", "_cy").count().where(F.col("count") > CROWD).select(*KEY, "_cx", "_cy", parts)
    return SheetGraph(nodes, members.union(alone.select(*KEY, "entity_id", F.col("entity_id").alias("node"))), apart, written(full, "full"))
