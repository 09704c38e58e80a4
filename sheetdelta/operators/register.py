"""Registration: anchors that name the same thing in both revisions, and the similarity transform that they support."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import centre, reference_point
from ..schema import THRESHOLDS, Thresholds
from ..tables import bounded, ship, written
from .ranking import ONE_TASK, numbered

ANCHOR = ["comparison_id", "source", "key", "ox", "oy", "nx", "ny"]


def _unique(entities: DataFrame, key: str) -> DataFrame:
    once = Window.partitionBy("comparison_id", "revision", key)
    return entities.where(F.col(key).isNotNull()).withColumn("_n", F.count("*").over(once)).where("_n = 1").drop("_n")


def _pairs(e: DataFrame, key: str, source: str) -> DataFrame:
    old = e.where("revision = 'old'").select("comparison_id", F.col(key).alias("key"), F.col("px").alias("ox"), F.col("py").alias("oy"))
    new = e.where("revision = 'new'").select("comparison_id", F.col(key).alias("key"), F.col("px").alias("nx"), F.col("py").alias("ny"))
    return old.join(new, ["comparison_id", "key"]).withColumn("source", F.lit(source)).select(*ANCHOR)


def text_anchors(entities: DataFrame) -> DataFrame:
    """Texts that occur once in each revision, at their reference points."""
    x, y = reference_point(F.col)
    return _pairs(_unique(entities, "text_payload").withColumns({"px": x, "py": y}), "text_payload", "text")


def geometry_anchors(entities: DataFrame) -> DataFrame:
    """Linework whose signature occurs once in each revision, at its centre."""
    x, y = centre(F.col)
    return _pairs(_unique(entities.where("kind = 'linework'"), "signature").withColumns({"px": x, "py": y}), "signature", "geometry")


def anchors(entities: DataFrame) -> DataFrame:
    return text_anchors(entities).union(geometry_anchors(entities))


def least_squares(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: the similarity n = a o + b (complex) of least squares, as scale, rotation, tx, ty.  Sums only."""
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias("m" + c) for c in ("ox", "oy", "nx", "ny")])
    d = pairs.join(g, keys)
    dox, doy, dnx, dny = [F.col(c) - F.col("m" + c) for c in ("ox", "oy", "nx", "ny")]
    s = d.groupBy(*keys, "n", "mox", "moy", "mnx", "mny").agg(
        F.sum(dox * dnx + doy * dny).alias("re"), F.sum(dox * dny - doy * dnx).alias("im"), F.sum(dox * dox + doy * doy).alias("ss")
    )
    s = s.withColumns({"a": F.when(F.col("ss") > 0, F.col("re") / F.col("ss")), "b": F.when(F.col("ss") > 0, F.col("im") / F.col("ss"))})
    return s.select(
        *keys,
        "n",
        F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("scale"),
        F.atan2("b", "a").alias("rotation"),
        (F.col("mnx") - (F.col("a") * F.col("mox") - F.col("b") * F.col("moy"))).alias("tx"),
        (F.col("mny") - (F.col("b") * F.col("mox") + F.col("a") * F.col("moy"))).alias("ty"),
    )


def _diagonal(sheets: DataFrame) -> DataFrame:
    return sheets.select("comparison_id", F.sqrt(F.col("new_width") ** 2 + F.col("new_height") ** 2).alias("diag"))


def consensus_all_pairs(pairs: DataFrame, sheets: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The two-anchor hypothesis of each comparison with most inliers, over all pairs i < j of its anchors (by ordinal, text
    first); a deterministic superset of random sampling for comparisons with few anchors."""
    order = Window.partitionBy("comparison_id").orderBy(F.when(F.col("source") == "text", 0).otherwise(1), "key")
    p = pairs.withColumn("i", F.row_number().over(order))
    q = p.select("comparison_id", *[F.col(c).alias(c + "2") for c in ("i", "ox", "oy", "nx", "ny")])
    h = p.join(q, "comparison_id").where("i < i2")
    dox, doy, dnx, dny = [F.col(c + "2") - F.col(c) for c in ("ox", "oy", "nx", "ny")]
    ss = dox * dox + doy * doy
    h = h.where(ss > 0).select(
        "comparison_id", "i", "i2", ((dox * dnx + doy * dny) / ss).alias("a"), ((dox * dny - doy * dnx) / ss).alias("b"), "ox", "oy", "nx", "ny"
    )
    h = h.select("comparison_id", "i", "i2", "a", "b", (F.col("nx") - F.col("a") * F.col("ox") + F.col("b") * F.col("oy")).alias("c"), (F.col("ny") - F.col("b") * F.col("ox") - F.col("a") * F.col("oy")).alias("d"))
    size = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
    h = h.where((size >= 0.2) & (size <= 5.0)).join(_diagonal(sheets), "comparison_id")
    t = h.join(pairs.select("comparison_id", "ox", "oy", "nx", "ny"), "comparison_id")
    ex = F.col("a") * F.col("ox") - F.col("b") * F.col("oy") + F.col("c") - F.col("nx")
    ey = F.col("b") * F.col("ox") + F.col("a") * F.col("oy") + F.col("d") - F.col("ny")
    t = t.groupBy("comparison_id", "i", "i2", "a", "b", "c", "d").agg(F.sum((F.sqrt(ex * ex + ey * ey) <= th.inlier * F.col("diag")).cast("int")).alias("inliers"))
    best = t.groupBy("comparison_id").agg(F.max_by(F.struct("i", "i2", "a", "b", "c", "d", "inliers"), F.struct("inliers", -F.col("i"), -F.col("i2"))).alias("h"))
    return best.select("comparison_id", "h.*")


def quality(pairs: DataFrame, fitted: DataFrame, sheets: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Per comparison of ``sheets``: anchors, inlier_ratio, rms_rel, status.  Comparisons without a fit are failed."""
    n = pairs.groupBy("comparison_id").agg(F.count("*").alias("anchors"))
    d = pairs.join(fitted.select("comparison_id", "scale", "rotation", "tx", "ty"), "comparison_id").join(_diagonal(sheets), "comparison_id")
    c, s = F.cos("rotation"), F.sin("rotation")
    ex = F.col("scale") * (c * F.col("ox") - s * F.col("oy")) + F.col("tx") - F.col("nx")
    ey = F.col("scale") * (s * F.col("ox") + c * F.col("oy")) + F.col("ty") - F.col("ny")
    d = d.withColumn("err2", ex * ex + ey * ey).withColumn("inlier", F.sqrt("err2") <= th.inlier * F.col("diag"))
    q = d.groupBy("comparison_id", "diag").agg(
        F.avg(F.col("inlier").cast("double")).alias("ratio"), F.sqrt(F.avg(F.when(F.col("inlier"), F.col("err2")))).alias("rms")
    )
    out = sheets.select("comparison_id").join(n, "comparison_id", "left").join(q, "comparison_id", "left")
    enough = F.coalesce("anchors", F.lit(0)) >= th.min_anchors
    ratio = F.when(enough, F.round(F.coalesce("ratio", F.lit(0.0)), 6)).otherwise(F.lit(0.0))
    rms = F.when(enough & F.col("rms").isNotNull(), F.round(F.col("rms") / F.col("diag"), 9)).otherwise(F.lit(1.0))
    ok = enough & (ratio >= th.min_inlier_ratio) & (rms <= th.inlier)
    return out.select("comparison_id", F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"), ratio.alias("inlier_ratio"), rms.alias("rms_rel"), F.when(ok, "aligned").otherwise("failed").alias("status"))


def drawn_pairs(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(n, round, i, j): the pairs of anchors, by number from 1, that a seeded generator draws among n; they depend on n only."""

    def draw(frames):
        for frame in frames:
            for n in frame["n"].tolist():
                source = random.Random(seed)
                rows = [(n, k, *(v + 1 for v in source.sample(range(n), 2))) for k in range(rounds)]
                yield pd.DataFrame(rows, columns=["n", "round", "i", "j"])

    ship(counts.sparkSession)
    return counts.select("n").distinct().mapInPandas(draw, "n long, round int, i long, j long")


def seeded_ransac(pairs: DataFrame, sheets: DataFrame, th: Thresholds = THRESHOLDS, rounds: int = 200, seed: int = 1337, one_task: int = ONE_TASK) -> DataFrame:
    """Per comparison with enough anchors: the transform of the largest sampled consensus, the first among equals, refined by least
    squares on it.

    The drawn pairs are a table, each a hypothesis of its comparison.  The hypotheses of a comparison are one array that meets its
    anchors, wherever these lie; an anchor leaves a row for each hypothesis that it agrees with, and those are counted by partial sums."""
    order = [F.when(F.col("source") == "text", 0).otherwise(1).asc(), F.asc("key"), *[F.asc(c) for c in ("ox", "oy", "nx", "ny")]]
    anchors = written(numbered(pairs.select(*ANCHOR), "comparison_id", order, "at", one_task), "anchors")
    counts = anchors.groupBy("comparison_id").agg(F.count("*").alias("n")).where(F.col("n") >= th.min_anchors)
    counts = written(counts.join(_diagonal(sheets), "comparison_id"), "counts")
    drawn = counts.join(written(drawn_pairs(counts, rounds, seed), "drawn"), "n").select("comparison_id", "diag", "round", "i", "j")
    end = lambda at, p: anchors.select("comparison_id", F.col("at").alias(at), *[F.col(c).alias(p + c) for c in ("ox", "oy", "nx", "ny")])
    drawn = drawn.join(end("i", "p"), ["comparison_id", "i"]).join(end("j", "q"), ["comparison_id", "j"])
    dx, dy, ex, ey = (F.col("q" + c) - F.col("p" + c) for c in ("ox", "oy", "nx", "ny"))
    size = dx * dx + dy * dy
    drawn = drawn.where(size > 0).withColumns({"a": (dx * ex + dy * ey) / size, "b": (dx * ey - dy * ex) / size}).where(F.hypot("a", "b").between(0.2, 5.0))
    a, b = F.col("a"), F.col("b")
    guess = F.struct("round", "a", "b", (F.col("pnx") - a * F.col("pox") + b * F.col("poy")).alias("c"), (F.col("pny") - b * F.col("pox") - a * F.col("poy")).alias("d"))
    guesses = written(drawn.groupBy("comparison_id", "diag").agg(F.collect_list(guess).alias("guesses")), "guesses")  # ``rounds`` at most

    def agrees(g: Column) -> Column:
        x = g["a"] * F.col("ox") - g["b"] * F.col("oy") + g["c"] - F.col("nx")
        y = g["b"] * F.col("ox") + g["a"] * F.col("oy") + g["d"] - F.col("ny")
        return F.hypot(x, y) <= th.inlier * F.col("diag")

    met = anchors.select(*ANCHOR).join(bounded(guesses), "comparison_id")
    hits = met.select("comparison_id", F.explode(F.transform(F.filter("guesses", agrees), lambda g: g["round"])).alias("round")).groupBy("comparison_id", "round").count()
    best = hits.groupBy("comparison_id").agg(F.max_by(F.struct("round", "count"), F.struct(F.col("count"), -F.col("round"))).alias("h")).where(F.col("h.count") >= 2)
    chosen = guesses.join(best, "comparison_id").select("comparison_id", "diag", F.get(F.filter("guesses", lambda g: g["round"] == F.col("h.round")), 0).alias("g"))
    inside = anchors.select(*ANCHOR).join(bounded(written(chosen, "chosen")), "comparison_id").where(agrees(F.col("g"))).select(*ANCHOR)
    return least_squares(inside, ["comparison_id"]).select("comparison_id", "n", "scale", "rotation", "tx", "ty")
