"""The library's queries: every operator applied to sheets derived from the test tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import location_bin, reference_point, transform_point
from ..functions.identity import shape_signature, with_identity
from ..functions.text import colour_hex, parse_dimension
from ..operators import features as ft
from ..operators import graph, joblog, jobs, match, register, report, score
from ..operators.assign import greedy_by_place
from ..operators.delta import compute_deltas, outcomes, violations
from ..schema import THRESHOLDS
from ..tables import written
from . import fixtures
from .compare import compare, matched

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities, written once per query that reads them often."""
    return with_identity(fixtures.entities(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str):
    return compare(fixtures.entities(spark, sf_dir), fixtures.sheets(spark), registered=True)


def _matched(spark: SparkSession, sf_dir: str):
    return matched(fixtures.entities(spark, sf_dir), fixtures.sheets(spark), registered=True)


def _on_deltas(f):
    """A query over (sheets, deltas)."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fixtures.sheets(spark), _compared(spark, sf_dir).deltas)

    return query(run)


def _r(c, n: int = 6):
    return F.round(c, n)


# Inputs and entities


@query
def validate_inputs(spark, sf_dir):
    """Pages stand in for uploads: their ids make every rule fire."""
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"))
    i = F.col("id")
    checks = p.select(
        (F.floor(i / 2)).cast("long").alias("comparison_id"),
        F.when(i % 2 == 0, "old").otherwise("new").alias("role"),
        jobs.validation_reason(
            F.when(i % 13 == 0, "a.dxf").otherwise("a.PDF"), F.when(i % 17 == 0, jobs.MAX_BYTES + 1).otherwise(i), F.when(i % 7 == 0, "%!PS-1").otherwise("%PDF-1.7"),
            i % 19 != 0, i % 23 == 0, i % 5, F.lit(4), i % 3, i % 4,
        ).alias("reason"),
    )
    return jobs.first_rejection(checks)


@query
def extract_dimensions(spark, sf_dir):
    e = _entities(spark, sf_dir).where("kind <> 'linework'")
    label, value = parse_dimension(F.col("text_payload"))
    return e.select("comparison_id", "revision", "ordinal", label.alias("label"), value.alias("value"))


@query
def colour_codes(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    r, g, b = [((F.col("p_partkey") * m) % 256) / F.lit(255.0) for m in (7, 11, 13)]
    return p.select("p_partkey", colour_hex(r, g, b).alias("colour"))


@query
def entity_ids(spark, sf_dir):
    return _entities(spark, sf_dir).select("comparison_id", "revision", "ordinal", "signature", "entity_id", shape_signature().alias("shape"))


@query
def reference_points(spark, sf_dir):
    """Where every old entity lands on the new sheet, and the ninth of the sheet it lies in."""
    e = _entities(spark, sf_dir).where("revision = 'old'").join(fixtures.sheets(spark), "comparison_id")
    x, y = transform_point(*reference_point(F.col), F.col)
    where = location_bin(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "old_width", "old_height")])
    return e.select("comparison_id", "ordinal", x.alias("x"), y.alias("y"), where.alias("location"))


@query
def inventory(spark, sf_dir):
    return score.inventory(fixtures.entities(spark, sf_dir))


@query
def entity_features(spark, sf_dir):
    f = ft.entity_features(_entities(spark, sf_dir), fixtures.sheets(spark))
    return f.select(*graph.KEY, "entity_id", *[_r(F.col(c)).alias(c) for c in [*ft.NAMES, "px", "py"]])


# Graph


@query
def knn_edges(spark, sf_dir):
    return graph.knn_edges(written(_entities(spark, sf_dir)))


@query
def touch_edges(spark, sf_dir):
    return graph.touch_edges(_entities(spark, sf_dir), fixtures.sheets(spark))


@query
def graph_edges(spark, sf_dir):
    return graph.graph_edges(written(_entities(spark, sf_dir)), fixtures.sheets(spark))


@query
def edge_degrees(spark, sf_dir):
    return graph.touch_degrees(written(_entities(spark, sf_dir)), fixtures.sheets(spark))


@query
def neighbour_aggregate(spark, sf_dir):
    e = written(_entities(spark, sf_dir))
    f = ft.entity_features(e, fixtures.sheets(spark), position=False)
    m = ft.touching_mean(f, e, fixtures.sheets(spark), ["w", "h", "stroke_width"])
    return m.select(*graph.KEY, "entity_id", *[_r(F.col("m_" + c)).alias("m_" + c) for c in ("w", "h", "stroke_width")])


# Similarity


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query
def cosine_pairs(spark, sf_dir):
    """Cosines within a label of vectors whose numbers lie within 40 of each other."""
    a = _vectors(spark, sf_dir)
    b = a.select(F.col("vec_id").alias("other"), "label", F.col("v").alias("w"))
    bucket = lambda c: F.floor(F.col(c) / 40)
    a = a.withColumn("_k", F.explode(F.sequence(bucket("vec_id"), bucket("vec_id") + 1)))
    pairs = a.join(b.withColumn("_k", bucket("other")), ["label", "_k"]).where((F.col("other") > F.col("vec_id")) & (F.col("other") - F.col("vec_id") <= 40))
    return pairs.select("label", "vec_id", "other", _r(match.cosine(F.col("v"), F.col("w"))).alias("similarity"))


def _groups(spark, sf_dir):
    """(old, new): even and odd vectors as the two revisions of comparisons of 60 numbers; every vector is in one."""
    v = _vectors(spark, sf_dir).withColumn("comparison_id", F.floor(F.col("vec_id") / 60).cast("int"))
    pick = lambda rest, id_, vector, kind: v.where(F.col("vec_id") % 2 == rest).select("comparison_id", F.col("vec_id").alias(id_), F.col("v").alias(vector), F.col("label").alias(kind))
    return pick(0, "old_id", "a", "a_kind"), pick(1, "new_id", "b", "b_kind")


@query
def cosine_matrix(spark, sf_dir):
    """Every old with every new vector of a comparison; -1 between kinds."""
    old, new = _groups(spark, sf_dir)
    s = F.when(F.col("a_kind") == F.col("b_kind"), match.cosine(F.col("a"), F.col("b"))).otherwise(F.lit(-1.0))
    return old.join(new, "comparison_id").select("comparison_id", "old_id", "new_id", _r(s).alias("similarity"))


@query
def cosine_topk(spark, sf_dir):
    """The five most similar vectors for every vector whose number is divisible by 50, against the whole table, in blocks."""
    v = written(_vectors(spark, sf_dir).select("vec_id", "v"), "vectors")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = match.shortlist(q, v, 5).select("query_id", "vec_id", _r("dot").alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where("rank <= 5").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "similarity")


@query
def similarity_gap(spark, sf_dir):
    """The halves of a vector, at unit length, as one entity in two revisions: the true pairs.  Every other pair of halves in a comparison
    of 60 vectors is false."""
    unit = lambda at: match.unit(F.slice("v", at, 32))
    v = written(_vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 60).cast("int").alias("comparison_id"), unit(1).alias("a"), unit(33).alias("b")), "halves")
    other = v.select("comparison_id", F.col("vec_id").alias("other_id"), F.col("b").alias("other"))
    pairs = v.join(other, "comparison_id").select("comparison_id", (F.col("vec_id") == F.col("other_id")).alias("is_true"), match.cosine(F.col("a"), F.col("other")).alias("similarity"))
    g = ft.similarity_gap(pairs, ["comparison_id"])
    return g.select("comparison_id", _r("min_true").alias("min_true"), _r("max_false").alias("max_false"))


def _learned(spark, sf_dir):
    """Even and odd vectors of a label as the two revisions of a comparison, 60 numbers to a comparison."""
    v = _vectors(spark, sf_dir).withColumn("comparison_id", (F.floor(F.col("vec_id") / 60)).cast("int"))
    v = v.select("comparison_id", F.when(F.col("vec_id") % 2 == 0, "old").otherwise("new").alias("revision"), F.col("vec_id").cast("string").alias("entity_id"), F.col("v").alias("vector"), F.col("label").cast("string").alias("kind"))
    old = v.where("revision = 'old'").select("comparison_id", F.col("entity_id").alias("a_entity_id"), F.col("kind").alias("a_kind"))
    new = v.where("revision = 'new'").select("comparison_id", F.col("entity_id").alias("b_entity_id"), F.col("kind").alias("b_kind"))
    return match.learned_matches(old, new, v)


@query
def match_learned(spark, sf_dir):
    return _learned(spark, sf_dir)[0].select("comparison_id", "old_id", "new_id", _r("similarity").alias("similarity"))


@query
def similarity_histogram(spark, sf_dir):
    return match.similarity_histogram(_learned(spark, sf_dir)[1], ["comparison_id"])


@query
def classifier_confidence(spark, sf_dir):
    """Labels for linework by size, learned from even ordinals, judged on the rest."""
    e = written(_entities(spark, sf_dir).where("kind = 'linework'"))
    names = ["w", "h", "aspect", "stroke_width", "px", "py"]
    f = ft.entity_features(e, fixtures.sheets(spark)).select(*graph.KEY, "entity_id", *names)
    truth = e.select(*graph.KEY, "entity_id", F.when(F.col("x1") - F.col("x0") >= 2 * (F.col("y1") - F.col("y0")), "wide").otherwise("tall").alias("truth"), (F.floor(F.col("ordinal") / 2) % 3).alias("part"))
    f = written(f.join(truth, [*graph.KEY, "entity_id"]))
    model = ft.train_classifier(f.where("part <> 0"), "truth", names)
    labelled = ft.classify(model, f.where("part = 0"))
    out = labelled.join(f.select(*graph.KEY, "entity_id", "truth"), [*graph.KEY, "entity_id"])
    return out.groupBy("comparison_id").agg(
        F.count("*").alias("n"), F.avg((F.col("semantic_label") == F.col("truth")).cast("double")).alias("accuracy"), F.count_if(F.col("semantic_confidence") < 0.5).alias("low_confidence")
    )


# Registration


@query
def text_anchors(spark, sf_dir):
    return register.text_anchors(_entities(spark, sf_dir))


@query
def geometry_anchors(spark, sf_dir):
    """Shapes repeat within a sheet, so each sheet is read as 50 small ones."""
    e = _entities(spark, sf_dir)
    return register.geometry_anchors(e.withColumn("comparison_id", (F.col("comparison_id") * 100 + F.floor(F.col("ordinal") / 2) % 50).cast("int")))


def _anchors(spark, sf_dir):
    return written(register.text_anchors(_entities(spark, sf_dir)))


@query
def fit_similarity_ls(spark, sf_dir):
    """The least-squares transform of every sheet, from all of its anchors."""
    f = register.least_squares(_anchors(spark, sf_dir), ["comparison_id"])
    return f.select("comparison_id", "n", *[_r(F.col(c), 4).alias(c) for c in ("scale", "rotation", "tx", "ty")])


@query
def registration_quality(spark, sf_dir):
    """Inliers and residuals of every sheet's given transform, over all of its anchors."""
    p = _anchors(spark, sf_dir)
    return register.quality(p, fixtures.sheets(spark), fixtures.sheets(spark)).select("comparison_id", "anchors", "inlier_ratio", _r("rms_rel", 4).alias("rms_rel"), "status")


@query
def consensus_all_pairs(spark, sf_dir):
    """All hypotheses over all anchors.  Each sheet is read as many small ones, 40 parts to each, so that every anchor is in
    exactly one and the work follows the table."""
    small = F.col("comparison_id") + 7 * F.floor(F.col("ordinal") / 2 / (7 * 40))
    e = written(_entities(spark, sf_dir).withColumns({"sheet": F.col("comparison_id"), "comparison_id": small.cast("int")}))
    sheets = fixtures.sheets(spark).withColumnRenamed("comparison_id", "sheet")
    sheets = e.select("comparison_id", "sheet").distinct().join(sheets, "sheet").drop("sheet")
    c = register.consensus_all_pairs(written(register.text_anchors(e)), sheets)
    return c.select("comparison_id", F.col("i").cast("long").alias("i"), F.col("i2").cast("long").alias("i2"), F.col("inliers").cast("long").alias("inliers"))


@query
def seeded_ransac(spark, sf_dir):
    f = register.seeded_ransac(_anchors(spark, sf_dir), fixtures.sheets(spark))
    return f.select("comparison_id", "n", *[_r(F.col(c), 6).alias(c) for c in ("scale", "rotation", "tx", "ty")])


# Matching


@query
def match_exact(spark, sf_dir):
    """Candidates of the exact tier: by signature on sheets that were only shifted, by numbers on the scaled one."""
    old, new = match.sides(written(_entities(spark, sf_dir)), fixtures.sheets(spark))
    return match.exact_candidates(old, new).select("comparison_id", "old_id", "new_id", _r("distance").alias("distance"))


@query
def match_attribute(spark, sf_dir):
    c = _matched(spark, sf_dir).matches
    return c.where("tier = 'attribute'").select("comparison_id", "old_id", "new_id")


@query
def match_greedy(spark, sf_dir):
    """Greedy pairs of one kind, 60 apart or less, where each has several partners, on every sheet."""
    e = written(_entities(spark, sf_dir))
    side = lambda rev, id_: e.where(F.col("revision") == rev).select("comparison_id", "kind", F.col("entity_id").alias(id_), F.col("x0").alias("x"), F.col("y0").alias("y"))
    g = greedy_by_place(side("old", "old_id"), side("new", "new_id"), ["comparison_id", "kind"], F.lit(60.0))
    return g.select("comparison_id", "old_id", "new_id", _r("distance").alias("distance"))


@query
def tier_counts(spark, sf_dir):
    return match.tier_counts(_matched(spark, sf_dir).matches)


@query
def unmatched_entities(spark, sf_dir):
    c = _matched(spark, sf_dir)
    return match.unmatched(c.entities, c.matches)


@query
def stage_signals(spark, sf_dir):
    """Counts of every stage of the comparison, as its log has them."""
    c = _compared(spark, sf_dir)
    return joblog.stage_signals(c.entities, c.matches, c.deltas, match.unmatched(c.entities, c.matches))


@query
def label_alignment(spark, sf_dir):
    """Records at the centres of the old entities, two points off, back to their entities, on every sheet."""
    e = written(_entities(spark, sf_dir).where("revision = 'old'"))
    records = e.select("comparison_id", "kind", F.col("ordinal").alias("record_id"), ((F.col("x0") + F.col("x1")) / 2 + 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return ft.align_records(e, records, F.lit(1031.0)).select("comparison_id", F.col("old_id").alias("entity_id"), F.col("new_id").alias("record_id"), _r("distance").alias("distance"))


# Changes and reports


def _flat(d: DataFrame) -> DataFrame:
    return d.select("comparison_id", "delta_id", "change_type", F.array_join("kinds", ",").alias("kinds"), "tier", "old_id", "new_id", "x0", "y0", "x1", "y1")


@_on_deltas
def deltas(sheets, d):
    return _flat(d)


@_on_deltas
def delta_violations(sheets, d):
    return violations(d).agg(F.count("*").alias("violations"))


@_on_deltas
def comparison_outcome(sheets, d):
    return outcomes(sheets, d)


@_on_deltas
def summary_lines(sheets, d):
    return report.summary_lines(d)


@_on_deltas
def change_report_counts(sheets, d):
    return report.change_counts(sheets, d)


@_on_deltas
def affected_area(sheets, d):
    return report.union_area(d, ["comparison_id"])


@_on_deltas
def severity(sheets, d):
    s = report.severity(sheets, d)
    return s.select("comparison_id", "changes", _r("area", 4).alias("area"), _r("affected_pct").alias("affected_pct"), "severity")


@_on_deltas
def summary_table(sheets, d):
    return report.summary_table(sheets, d)


@_on_deltas
def summary_lookup(sheets, d):
    """The sentence of every row of the table, found by its change."""
    rows = report.summary_table(sheets, d).select("comparison_id", "position", "change", "delta_id")
    return rows.join(report.summary_lines(d), ["comparison_id", "delta_id"]).select("comparison_id", "position", "change", "text")


@query
def moved_vs_removed(spark, sf_dir):
    """The learned tier in the whole flow: parts moved by 20, and parts gone here and come again 300 further down, have one vector on
    both sheets.  The first are moves with a similarity; the second are too far apart, so one entity is gone and another come."""
    e = fixtures.entities(spark, sf_dir).withColumn("k", F.floor(F.col("ordinal") / 2))
    label = F.when(F.col("kind") == "linework", F.when(F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0"), "wide").otherwise("tall"))
    e = e.withColumns({"semantic_label": label, "semantic_confidence": F.when(label.isNotNull(), 0.5 + F.col("k") % 40 / 100)})
    again = F.col("ordinal") % 2 == 1
    moved = (F.col("k") % 19 == 0) & (F.col("k") % 17 != 0) & ~again
    apart = (F.col("k") % 527 == 0) & ((F.col("revision") == "old") | again)
    angle = F.col("k") * 2.399963
    named = written(with_identity(e), "entities")
    vectors = named.where(moved | apart).select("comparison_id", "revision", "entity_id", F.array(F.cos(angle), F.sin(angle)).alias("vector"))
    sheets = fixtures.sheets(spark)
    c = compare(e.drop("k"), sheets, vectors, registered=True)
    rows = report.summary_table(sheets, c.deltas).join(report.summary_lines(c.deltas), ["comparison_id", "delta_id"])
    d = c.deltas.select("comparison_id", "delta_id", "change_type", F.array_join("kinds", ",").alias("kinds"), "tier", "similarity", F.coalesce("new_id", "old_id").alias("entity_id"))
    return d.join(rows.select("comparison_id", "delta_id", "entity", "confidence", "text"), ["comparison_id", "delta_id"])


@_on_deltas
def top_changes(sheets, d):
    return report.top_changes(d, 15, ["modified", "removed"]).select("comparison_id", F.col("position").cast("long").alias("position"), "delta_id")


@_on_deltas
def first_changes(sheets, d):
    """The first 15 changes of all types, as the report lists them."""
    return report.top_changes(d).select("comparison_id", F.col("position").cast("long").alias("position"), "delta_id")


@_on_deltas
def recommendations(sheets, d):
    r = report.recommendations(report.severity(sheets, d), report.change_counts(sheets, d), d)
    return r.select("comparison_id", F.array_join("recommendations", " ").alias("recommendations"))


@_on_deltas
def markup_annotations(sheets, d):
    return report.markup_annotations(d)


@_on_deltas
def heat_circles(sheets, d):
    return report.heat_circles(sheets, d)


@_on_deltas
def change_values(sheets, d):
    return report.change_values(d)


@_on_deltas
def change_rollup(sheets, d):
    """Counts by type and kind with subtotals."""
    here = F.coalesce(F.col("after"), F.col("before"))
    return d.select("change_type", here["kind"].alias("kind")).rollup("change_type", "kind").agg(F.count("*").alias("n"))


@query
def canonical_report_json(spark, sf_dir):
    return report.canonical_reports(fixtures.sheets(spark), _compared(spark, sf_dir).deltas)


@query
def compare_registered(spark, sf_dir):
    """The whole flow with fitted transforms: outcome and counts."""
    s = fixtures.sheets(spark)
    c = compare(fixtures.entities(spark, sf_dir), s)
    n = report.change_counts(s, c.deltas)
    return c.outcomes.join(n, "comparison_id").select("comparison_id", "outcome", "added", "removed", "modified")


@query
def score_precision_recall(spark, sf_dir):
    """The rules of the derivation are the answer key."""
    from .oracles import KEY_SQL

    s = fixtures.sheets(spark)
    d = written(_compared(spark, sf_dir).deltas)
    here = F.coalesce(F.col("after"), F.col("before"))
    order = Window.partitionBy("comparison_id").orderBy("change_type", "y0", "x0", "delta_id")
    found = d.select("comparison_id", "change_type", here["kind"].alias("kind"), "x0", "y0", "x1", "y1", F.col("before")["dimension_value"].alias("old_value"), F.col("after")["dimension_value"].alias("new_value"), F.row_number().over(order).alias("found_id"))
    key = spark.sql(KEY_SQL.replace("FROM part", "FROM {part}"), part=_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return score.precision_recall(found, key, s).select("comparison_id", "matched", "found", "expected", _r("precision").alias("precision"), _r("recall").alias("recall"))


# Jobs


def _jobs(spark, sf_dir):
    """Events as jobs: their time is the creation, their id the state."""
    states = F.array(*[F.lit(s) for s in ("pending", "matching", "done", "failed", "rejected", "declined")])
    i = F.col("event_id")
    e = _table(spark, sf_dir, "events").select(
        i.alias("job_id"), F.when(i % 11 != 0, F.get(states, (i % 6).cast("int"))).alias("state"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.col("ts").alias("newest_file")
    )
    return e


@query
def ttl_sweep(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return jobs.expired(j, now).select("job_id", "state")


@query
def ttl_keep(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return jobs.keep_set(j, jobs.expired(j, now)).groupBy("state").agg(F.count("*").alias("n"))


@query
def stage_timings(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("job_id"), F.col("event_type").alias("stage"), F.round("value", 2).alias("ms"))
    t = jobs.stage_timings(e)
    return t.select("job_id", _r("total_ms", 2).alias("total_ms"), F.size("timings").cast("long").alias("stages"))


# Beyond the comparison: what the platform gives for tables of events


@query
def extra_tumbling(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))


@query
def extra_sessions(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("n"))


@query
def extra_rollup(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _r(F.sum("l_quantity"), 2).alias("quantity"))


@query
def extra_asof(spark, sf_dir):
    """For every purchase the latest earlier view of the same user, by a window over both."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "view_id")
