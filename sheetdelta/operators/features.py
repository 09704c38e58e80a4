"""Entity features, one round of neighbour aggregation, similarity statistics, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KINDS
from ..tables import written
from .assign import greedy_by_place
from .graph import BOX, KEY, alike, both_directions, touching_groups

NAMES = [*[f"is_{k}" for k in KINDS], "w", "h", "aspect", "segments", "lines", "rects", "curves", "stroke_width", "has_text", "text_length", "digits", "uppers"]


def entity_features(entities: DataFrame, sheets: DataFrame, position: bool = True) -> DataFrame:
    """The 17 features of each entity, and its place on the sheet if ``position``."""
    old = F.col("revision") == "old"
    e = entities.join(sheets.select("comparison_id", "old_width", "old_height", "new_width", "new_height"), "comparison_id")
    sw, sh = F.when(old, F.col("old_width")).otherwise(F.col("new_width")), F.when(old, F.col("old_height")).otherwise(F.col("new_height"))
    diag = F.sqrt(sw * sw + sh * sh)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.size("geometry")
    count = lambda *ks: F.size(F.filter("geometry", lambda s: s["kind"].isin(*ks)))
    per = F.greatest(n, F.lit(1))
    text = F.coalesce("text_payload", F.lit(""))
    length = F.char_length(text)
    share = lambda keep: F.when(length > 0, F.char_length(F.regexp_replace(text, keep, "")) / length).otherwise(F.lit(0.0))
    values = [
        *[F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS], w / diag, h / diag, F.least(w / (h + 1e-6), F.lit(10.0)) / 10, F.least(n, F.lit(10)) / 10,
        count("line") / per, count("rect") / per, count("curve", "quad") / per, F.least(F.coalesce("width", F.lit(0.0)), F.lit(20.0)) / 20,
        F.when(length > 0, 1.0).otherwise(0.0), F.least(length, F.lit(32)) / 32, share(r"[^\p{Nd}]"), share(r"[^\p{Lu}]"),
    ]
    out = [v.cast("double").alias(c) for v, c in zip(values, NAMES)]
    if position:
        out += [((F.col("x0") + F.col("x1")) / 2 / sw).alias("px"), ((F.col("y0") + F.col("y1")) / 2 / sh).alias("py")]
    return e.select(*KEY, "entity_id", *out)


def neighbour_mean(features: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """Each entity's features beside the means over its neighbours (``m_`` names; zero without neighbours): one message round."""
    e = both_directions(edges)
    around = e.join(features.select(*KEY, F.col("entity_id").alias("target"), *names), [*KEY, "target"])
    mean = around.groupBy(*KEY, F.col("source").alias("entity_id")).agg(*[F.avg(c).alias("m_" + c) for c in names])
    out = features.select(*KEY, "entity_id", *names).join(mean, [*KEY, "entity_id"], "left")
    return out.select(*KEY, "entity_id", *names, *[F.coalesce("m_" + c, F.lit(0.0)).alias("m_" + c) for c in names])


def touching_mean(features: DataFrame, entities: DataFrame, sheets: DataFrame, names: list[str]) -> DataFrame:
    """``neighbour_mean`` over ``touch_edges``, without the edges: entities with equal boxes and features are one group with a number."""
    e = written(entities.select(*KEY, "entity_id", *BOX).join(features.select(*KEY, "entity_id", F.array(*names).alias("v")), [*KEY, "entity_id"]), "boxes")
    groups = written(alike(e, "v"), "groups")
    around = touching_groups(groups, sheets, "v").where("n > 0")
    of = lambda i: F.get("v", F.lit(i))
    mean = [(F.sum(F.col("n") * of(i)) / F.sum(F.when(of(i).isNotNull(), F.col("n")))).alias("m_" + c) for i, c in enumerate(names)]
    found = groups.join(around.groupBy(*KEY, F.col("target").alias("entity_id")).agg(*mean), [*KEY, "entity_id"]).drop("entity_id", "n")
    out = e.join(found, [*KEY, *BOX, "v"], "left")
    return out.select(*KEY, "entity_id", *[of(i).alias(c) for i, c in enumerate(names)], *[F.coalesce("m_" + c, F.lit(0.0)).alias("m_" + c) for c in names])


def unit_vectors(features: DataFrame, names: list[str]) -> DataFrame:
    """Features as one array of unit length, named vector."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    return features.select(*KEY, "entity_id", F.array(*[F.when(norm > 0, F.col(c) / norm).otherwise(F.lit(0.0)) for c in names]).alias("vector"))


def train_classifier(features: DataFrame, label: str, names: list[str], seed: int = 1337):
    """A multinomial model over the features; rows without a label are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    stages = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=names, outputCol="_features"),
        LogisticRegression(labelCol="_label", featuresCol="_features", probabilityCol="_p", predictionCol="_k", rawPredictionCol="_raw", regParam=1e-3, maxIter=60),
    ]
    return Pipeline(stages=stages).fit(features.where(F.col(label).isNotNull()))


def classify(model, features: DataFrame) -> DataFrame:
    """(…key, semantic_label, semantic_confidence), confidence to six digits."""
    from pyspark.ml.functions import vector_to_array

    labels = F.array(*[F.lit(v) for v in model.stages[0].labels])
    from pyspark.ml import PipelineModel

    done = PipelineModel(model.stages[1:]).transform(features)
    p = vector_to_array("_p")
    return done.select(*KEY, "entity_id", F.get(labels, F.col("_k").cast("int")).alias("semantic_label"), F.round(F.array_max(p), 6).alias("semantic_confidence"))


def low_confidence(labelled: DataFrame, keys: list[str], bound: float = 0.5) -> DataFrame:
    return labelled.groupBy(*keys).agg(F.count_if(F.col("semantic_confidence") < bound).alias("low_confidence"), F.count("*").alias("n"))


def similarity_gap(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least similarity of true pairs and largest of false ones."""
    true = F.col("is_true")
    return pairs.groupBy(*keys).agg(F.min(F.when(true, F.col("similarity"))).alias("min_true"), F.max(F.when(~true, F.col("similarity"))).alias("max_false"))


def align_records(entities: DataFrame, records: DataFrame, diag: Column, share: float = 0.02) -> DataFrame:
    """Ground-truth records (comparison_id, record_id, kind, cx, cy) to entities of the same kind within a share of the diagonal,
    nearest first, one to one."""
    e = entities.select("comparison_id", "kind", F.col("entity_id").alias("old_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    r = records.select("comparison_id", "kind", F.col("record_id").alias("new_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return greedy_by_place(e, r, ["comparison_id", "kind"], diag * share).select("comparison_id", "distance", "old_id", "new_id")
