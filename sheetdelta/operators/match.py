"""Matching in tiers: exact, changed in place, similar.  Each tier sees only what the cheaper ones left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import centre, displacement, iou, mapped_box, mapped_corners, shape_equivalent, shape_text, side, style_equivalent, transform_point
from ..functions.numbers import fixed
from ..schema import SIDE, THRESHOLDS, Thresholds
from ..tables import bounded, ship, written
from .assign import classes, greedy_of_classes, optimal_by_vectors
from .grid import cell_sizes, with_cells

A, B, T = side("a_"), side("b_"), F.col


def sides(entities: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old entities with their sheet's transform, diagonal and cell size, and new entities with its cell size; columns prefixed a_ and b_."""
    s = sheets.withColumn("diag", F.sqrt(F.col("new_width") ** 2 + F.col("new_height") ** 2))
    # Both sides meet on the new sheet's cells, whose size follows its density.
    inside = entities.where("revision = 'new'").join(bounded(s.select("comparison_id", "new_width", "new_height", "diag")), "comparison_id")
    sizes = written(cell_sizes(inside, ["comparison_id"], F.col("new_width"), F.col("new_height"), 0.005 * F.col("diag")), "cells")
    s = s.select("comparison_id", "diag", "tx", "ty", "scale", "rotation").join(sizes, "comparison_id", "left").withColumn("cell", F.coalesce("cell", F.col("diag") / 64))
    s = bounded(s)
    old = entities.where("revision = 'old'").select("comparison_id", *[F.col(c).alias("a_" + c) for c in [*SIDE, "signature"]]).join(s, "comparison_id")
    new = entities.where("revision = 'new'").select("comparison_id", *[F.col(c).alias("b_" + c) for c in [*SIDE, "signature"]])
    new = new.join(s.select("comparison_id", F.col("cell").alias("b_cell"), _plain().alias("b_plain")), "comparison_id")
    return old, new


def _candidate(pairs: DataFrame) -> DataFrame:
    return pairs.select("comparison_id", F.col("distance"), F.col("a_entity_id").alias("old_id"), F.col("b_entity_id").alias("new_id"))


def _plain() -> Column:
    return (F.col("scale") == 1.0) & (F.col("rotation") == 0.0)


def exact_candidates(old: DataFrame, new: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Equal content at the registered place.  Pure shifts compare signatures; other transforms compare kind, text, shape and
    style.  Both meet on the grid cell of the place as well: linework has no text, and a sheet has few signatures of it."""
    reach = th.exact * F.col("diag")
    # An exact match may sit one tolerance beyond a cell's edge, so the old side goes to every cell it may fall in.
    wide = reach * 1.000001
    px, py = F.col("_px"), F.col("_py")
    o = with_cells(_measured(old, A, T), px - wide, py - wide, px + wide, py + wide, F.col("cell"))
    n = _measured(new, B, None).withColumns({"_cx": F.floor(px / F.col("b_cell")).cast("long"), "_cy": F.floor(py / F.col("b_cell")).cast("long")})
    same = lambda df, c, plain: df.withColumns({"_what": F.when(plain, F.col(c + "signature")).otherwise(F.col(c + "text_payload")), "_kind": F.when(~plain, F.col(c + "kind"))})
    o, n = same(o, "a_", _plain()).drop("_px", "_py"), same(n, "b_", F.col("b_plain")).drop("_px", "_py")
    keys = [o[c] == n[c] for c in ("comparison_id", "_how", "_cx", "_cy")] + [o[c].eqNullSafe(n[c]) for c in ("_what", "_kind")]
    pairs = o.join(n, keys).drop(n["comparison_id"]).withColumn("distance", displacement(A, B, T)).where(F.col("distance") <= reach)
    return _candidate(pairs.where(_plain() | (shape_equivalent(A, B, T, reach) & style_equivalent(A, B, T))))


def _measured(rows: DataFrame, e, t) -> DataFrame:
    """One row for each point by which an entity may be measured (``_px``, ``_py``): between anchors if both sides have one (``_how`` 0),
    else between centres, where the old side alone has one (1) or has none (2)."""
    spot = lambda how, at: F.struct(F.lit(how).alias("how"), at[0].alias("x"), at[1].alias("y"))
    anchor, middle = transform_point(e("anchor_x"), e("anchor_y"), t), transform_point(*centre(e), t)
    own, others = ([1], [2]) if e is A else ([2], [1, 2])
    spots = F.when(e("anchor_x").isNotNull(), F.array(spot(0, anchor), *[spot(k, middle) for k in own])).otherwise(F.array(*[spot(k, middle) for k in others]))
    return rows.withColumn("_spot", F.explode(spots)).withColumns({"_how": F.col("_spot.how"), "_px": F.col("_spot.x"), "_py": F.col("_spot.y")}).drop("_spot")


def _unread(rows: DataFrame, c: str, plain: Column) -> DataFrame:
    """Sides without what the exact tier does not read of them, so that more of them are one class: on a sheet that was only shifted the
    signature stands for all content, elsewhere it is not looked at."""
    content = ("kind", "geometry", "text_payload", "stroke", "fill", "width")
    return rows.withColumns({f"{c}_signature": F.when(plain, F.col(f"{c}_signature"))} | {f"{c}_{x}": F.when(~plain, F.col(f"{c}_{x}")) for x in content})


def _place(e, box) -> tuple[Column, Column]:
    """An entity's anchor on the new sheet, or the middle of its box."""
    px, py = transform_point(e("anchor_x"), e("anchor_y"), T) if e is A else (e("anchor_x"), e("anchor_y"))
    return F.coalesce(px, (box[0] + box[2]) / 2), F.coalesce(py, (box[1] + box[3]) / 2)


def remaining(rows: DataFrame, taken: DataFrame, own: str, other: str) -> DataFrame:
    return rows.join(taken.select("comparison_id", F.col(other).alias(own)), ["comparison_id", own], "left_anti")


def attribute_candidates(old: DataFrame, new: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Pairs of one kind that changed in place.  Boxes widened by the tolerance meet on grid cells, then the rule decides."""
    old, new = old.withColumn("_shape_a", shape_text(A("geometry"))), new.withColumn("_shape_b", shape_text(B("geometry")))
    tol = th.in_place * F.col("diag")
    box = mapped_box(A, T)
    o = with_cells(old, F.least(box[0], _place(A, box)[0]) - tol, F.least(box[1], _place(A, box)[1]) - tol, F.greatest(box[2], _place(A, box)[0]) + tol, F.greatest(box[3], _place(A, box)[1]) + tol, F.col("cell"))
    bx, by = _place(B, (B("x0"), B("y0"), B("x1"), B("y1")))
    if th.iou > 0.5:
        # Who overlaps by more than half has the other's middle inside, so the new side is found by its middle or its anchor.
        spots = F.array_distinct(F.array(*[F.struct(*[F.floor(v / F.col("b_cell")).cast("long").alias(k) for k, v in zip(("_cx", "_cy"), at)]) for at in (centre(B), (bx, by))]))
        n = new.select("*", F.inline(spots))
    else:
        n = with_cells(new, F.least(B("x0"), bx), F.least(B("y0"), by), F.greatest(B("x1"), bx), F.greatest(B("y1"), by), F.col("b_cell"))
    keys = (o["comparison_id"] == n["comparison_id"]) & (o["_cx"] == n["_cx"]) & (o["_cy"] == n["_cy"]) & (o["a_kind"] == n["b_kind"])
    pairs = o.join(n, keys).drop(n["comparison_id"]).withColumn("distance", displacement(A, B, T))
    near = F.col("distance") <= tol
    # Corners are not put in order: after a turn that swaps them nothing overlaps, and shape or place decide.
    overlap = iou(mapped_corners(A, T), (B("x0"), B("y0"), B("x1"), B("y1"))) >= th.iou
    written_kind = F.col("a_kind").isin("text", "dimension")
    # For a dimension with equal labels and for any other text the place alone decides; shapes may also overlap.
    rule = F.when(written_kind, near).otherwise((near & shape_equivalent(A, B, T, th.exact * F.col("diag"), (F.col("_shape_a"), F.col("_shape_b")))) | overlap)
    return _candidate(pairs.where(rule)).distinct()


def learned_matches(old: DataFrame, new: DataFrame, vectors: DataFrame, th: Thresholds = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(matches, assignment): rest against rest by cosine, -1 between kinds; the best total per comparison is chosen first and the
    threshold applied afterwards.  ``vectors``: comparison_id, entity_id, revision, vector (unit length).

    No cosine is under -1, so a pair of one kind never stands behind two pairs of different kinds: kinds are solved apart, and what
    one side has over is paired with what the other has over, at -1."""
    of = lambda rev: vectors.where(F.col("revision") == rev).select("comparison_id", F.col("entity_id").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rest = lambda df, p: df.select("comparison_id", F.col(p + "entity_id").alias("id"), F.col(p + "kind").alias("kind"))
    a = written(rest(old, "a_").join(of("old"), ["comparison_id", "id"]).withColumnRenamed("id", "old_id"), "rest")
    b = written(rest(new, "b_").join(of("new"), ["comparison_id", "id"]).withColumnRenamed("id", "new_id"), "rest")
    paired = written(optimal_by_vectors(a, b, ["comparison_id", "kind"]).drop("kind"), "assigned")

    def over(df: DataFrame, own: str) -> DataFrame:
        left = df.join(paired.select("comparison_id", own), ["comparison_id", own], "left_anti")
        return left.select("comparison_id", own, F.row_number().over(Window.partitionBy("comparison_id").orderBy(own)).alias("n"))

    crossed = over(a, "old_id").join(over(b, "new_id"), ["comparison_id", "n"]).select("comparison_id", "old_id", "new_id", F.lit(-1.0).alias("similarity"))
    assigned = paired.unionByName(crossed)
    return paired.where(F.col("similarity") >= th.similarity), assigned


def cosine(a: Column, b: Column) -> Column:
    """Dot product, which is the cosine for vectors of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """``v`` at unit length; a zero vector stays."""
    norm = F.sqrt(cosine(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def similarity_histogram(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per tenth of all assigned pairs, rejected ones included; labels as a number with one decimal."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(0.999), F.col("similarity")))
    label = fixed(s, 1)
    return assigned.groupBy(*keys, label.alias("bucket")).agg(F.count("*").alias("n"))


def _one_to_one(old: DataFrame, new: DataFrame, candidates, th: Thresholds, unread: tuple[str, ...] = ()) -> DataFrame:
    """(comparison_id, old_id, new_id) of the greedy pass over ``candidates`` of two sides.  Entities that are equal in all that the rules of
    candidates read are one class, so copies at one place are not paired with each other one by one.  ``unread``: what these rules, unlike
    those of other tiers, do not read."""
    not_read = ("entity_id", "label", "dimension_value", "semantic_label", "semantic_confidence", *unread)

    def side(rows: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
        read = [x for x in rows.columns if x != "comparison_id" and x not in [f"{c}_{n}" for n in not_read]]
        # Places first: the groups are sorted by them, and they differ most.
        read.sort(key=lambda x: x[2:] not in ("x0", "y0"))
        found = classes(rows, ["comparison_id"], read, f"{c}_entity_id", c)
        return found.select("comparison_id", c, "ids", "used"), found.drop("ids", "used").withColumnRenamed(c, f"{c}_entity_id")

    (olds, a), (news, b) = side(old, "a"), side(new, "b")
    pairs = candidates(a, b, th).select("comparison_id", "distance", F.col("old_id").alias("a"), F.col("new_id").alias("b"))
    return greedy_of_classes(pairs, olds, news, ["comparison_id"])[0].select("comparison_id", "old_id", "new_id")


def match_entities(entities: DataFrame, sheets: DataFrame, vectors: DataFrame | None = None, th: Thresholds = THRESHOLDS) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(matches, rest): comparison_id, old_id, new_id, tier, similarity, and the two sides that the exact tier left, as of ``sides``."""
    old, new = sides(entities, sheets)
    exact = _one_to_one(_unread(old, "a", _plain()), _unread(new, "b", F.col("b_plain")), exact_candidates, th)
    rest = old, new = written(remaining(old, exact, "a_entity_id", "old_id"), "old"), written(remaining(new, exact, "b_entity_id", "new_id"), "new")
    attribute = _one_to_one(old, new, attribute_candidates, th, ("signature", "text_payload", "stroke", "fill", "width"))
    none = F.lit(None).cast("double").alias("similarity")
    out = exact.select("comparison_id", "old_id", "new_id", F.lit("exact").alias("tier"), none).union(
        attribute.select("comparison_id", "old_id", "new_id", F.lit("attribute").alias("tier"), none)
    )
    if vectors is not None:
        old, new = remaining(old, attribute, "a_entity_id", "old_id"), remaining(new, attribute, "b_entity_id", "new_id")
        learned, _ = learned_matches(old, new, vectors, th)
        out = out.union(learned.select("comparison_id", "old_id", "new_id", F.lit("learned").alias("tier"), F.round("similarity", 6).alias("similarity")))
    return written(out, "matches"), rest


def unmatched(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(comparison_id, revision, entity_id) of every entity in no match."""
    e = entities.select("comparison_id", "revision", "entity_id")
    ends = matches.select("comparison_id", F.lit("old").alias("revision"), F.col("old_id").alias("entity_id")).union(matches.select("comparison_id", F.lit("new"), "new_id"))
    return e.join(ends, ["comparison_id", "revision", "entity_id"], "left_anti")


def tier_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("comparison_id", "tier").agg(F.count("*").alias("n"))


#: Rows and queries of a block, queries whose products with a block of rows are held at once, and what six digits may round together.
ROWS, QUERIES, AT_ONCE, SAME = 10_000, 2_000, 200, 2e-6


def shortlist(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, dot): per block of rows, all that may be among a query's ``k`` first by its dot product to six digits, ties to the
    lower vec_id.  ``queries``: query_id, q; ``rows``: vec_id, v; a row is not its own query's.

    Each block of queries meets each block of rows once, so no task holds either side whole.  A matrix product finds the candidates; their
    own products are added up from the first component to the last, as an array function does.  No vector or component: no product."""
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c))
    blocks = lambda df, size: F.lit(max(1, -(-df.count() // size)))
    of_rows, of_queries = blocks(rows, ROWS), blocks(queries, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = queries.select("query_id", whole("q").alias("q")).withColumn("i", F.pmod(F.xxhash64("query_id"), of_queries).cast("int")).withColumn("j", every(of_rows))
    v = rows.select("vec_id", whole("v").alias("v")).withColumn("j", F.pmod(F.xxhash64("vec_id"), of_rows).cast("int")).withColumn("i", every(of_queries))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id")
        size = lambda x: -1 if x is None else len(x)
        a_size, b_size = a["q"].map(size).to_numpy(int), b["v"].map(size).to_numpy(int)
        qs, vs, out = a["query_id"].to_numpy(), b["vec_id"].to_numpy(), []
        for n in set(a_size.tolist()):
            here, fit = np.flatnonzero(a_size == n), np.flatnonzero((b_size == n) & (n >= 0))
            other = vs[np.setdiff1d(np.arange(len(vs)), fit)][: k + 1]
            for at in range(0, len(here), AT_ONCE):
                mine = here[at : at + AT_ONCE]
                out += [(int(qs[i]), int(x), None) for i in mine for x in other if x != qs[i]]
                if not len(fit):
                    continue
                x, y = np.array([np.asarray(a["q"].iat[i], float) for i in mine]).reshape(len(mine), n), np.array([np.asarray(b["v"].iat[j], float) for j in fit]).reshape(len(fit), n)
                with np.errstate(all="ignore"):
                    grid = x @ y.T
                    grid[qs[mine][:, None] == vs[fit][None, :]] = -np.inf
                    last = np.partition(grid, -k, axis=1)[:, -k] if len(fit) > k else np.full(len(mine), -np.inf)
                    r, c = np.nonzero((qs[mine][:, None] != vs[fit][None, :]) & ((grid >= (last - SAME)[:, None]) | ~np.isfinite(grid)))
                    dot = np.zeros(len(r))
                    for d in range(n):
                        dot = dot + x[r, d] * y[c, d]
                # Rows of a query come by vec_id; of equal products the first k are enough.
                found = pd.DataFrame({"query_id": qs[mine][r], "vec_id": vs[fit][c], "dot": dot})
                found = found[found.groupby(["query_id", "dot"], dropna=False).cumcount() < k]
                out += list(zip(found["query_id"].tolist(), found["vec_id"].tolist(), found["dot"].tolist()))
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "dot"])
        # On the way back a NaN would become a null.
        return frame.assign(dot=frame["dot"].astype(float), nan=[x is not None and x != x for *_, x in out])

    ship(rows.sparkSession)
    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInPandas(block, "query_id long, vec_id long, dot double, nan boolean")
    return found.select("query_id", "vec_id", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("dot")).alias("dot"))
