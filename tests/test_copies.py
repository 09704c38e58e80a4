"""Sheets where many entities lie at one place: the work follows the places, the results are those of all pairs."""

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetdelta import catalogue
from sheetdelta.functions.identity import with_identity
from sheetdelta.operators import assign, attention, graph, match, report
from sheetdelta.operators import features as ft
from sheetdelta.operators.graph import KEY
from sheetdelta.plans import fixtures
from sheetdelta.plans.compare import matched
from sheetdelta.schema import ENTITY, SHEET
from sheetdelta.tables import written

SHEETS = "comparison_id int, old_width double, old_height double, new_width double, new_height double"


def crowded(spark, places=40, copies=5):
    """Boxes at few places, several to each, and one far from all others."""
    r = np.random.default_rng(11)
    rows = []
    for k in range(places):
        x, y, w, h = (float(v) for v in (*r.integers(0, 120, 2), *r.integers(2, 14, 2)))
        rows += [(1, rev, f"{rev}{c * places + k:05}", x, y, x + w, y + h) for rev in ("old", "new") for c in range(copies)]
    rows.append((1, "old", "old99999", 700.0, 500.0, 702.0, 502.0))
    e = spark.createDataFrame(rows, "comparison_id int, revision string, entity_id string, x0 double, y0 double, x1 double, y1 double")
    return written(e), spark.createDataFrame([(1, 842.0, 595.0, 842.0, 595.0)], SHEETS)


def inputs(e):
    """Features that differ between some copies."""
    value = lambda i: (F.pmod(F.substring("entity_id", -2, 2).cast("int"), F.lit(2 + i % 2)) + i) / 20
    return written(e.select(*KEY, "entity_id", *[F.coalesce(value(i), F.lit(0.5)).alias(c) for i, c in enumerate([*ft.NAMES, "px", "py"])]))


def test_touching_without_edges(spark):
    e, s = crowded(spark)
    f = inputs(e)
    edges = graph.touch_edges(e, s)
    plain = lambda df: {(r.revision, r.entity_id): tuple(r)[3:] for r in df.collect()}
    assert plain(graph.touch_degrees(e, s)) == plain(graph.degrees(edges))
    got, want = (plain(m.select(*KEY, "entity_id", "m_w", "m_h")) for m in (ft.touching_mean(f, e, s, ["w", "h"]), ft.neighbour_mean(f, edges, ["w", "h"])))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_copies_are_not_paired(spark):
    """Twice the copies, the same pairs of groups, for plain boxes and for the nodes of the attention."""
    pairs = []
    for copies in (10, 20):
        e, s = crowded(spark, copies=copies)
        x = e.select(*KEY, "entity_id", F.array(F.lit(1.0)).alias("x"))
        g = graph.sheet_graph(e, s, x)
        nodes = g.nodes.select(*KEY, "entity_id")
        heard = g.pairs(nodes.withColumnRenamed("entity_id", "source"), nodes.withColumnRenamed("entity_id", "target"))
        pairs.append((graph.touching_groups(graph.alike(e), s).count(), heard.count()))
        assert g.members.count() == e.count()
    assert pairs[0] == pairs[1]


def test_edges_need_no_shuffle(spark):
    """Both kinds of edges are given out where they are found."""
    e, s = crowded(spark)
    edges = graph.graph_edges(e, s)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union")
    assert edges.count() == edges.distinct().count()


def test_attention_without_edges(spark):
    e, s = crowded(spark, places=6, copies=3)
    f = inputs(e)
    edges = written(graph.graph_edges(e, s))
    encoder = attention.probe(attention.ENCODER)
    by = lambda df, c: {(r.revision, r.entity_id): r[c] for r in df.collect()}
    got, want = by(attention.encode_sheets(e, s, f, encoder), "vector"), by(attention.encode(f, edges, encoder), "vector")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("crowd,name", [(2_048, "conv1"), (3, "conv2")])
def test_attention_in_cells(spark, monkeypatch, crowd, name):
    """A layer over a sheet adds up touching nodes in their cells, without a row for each pair (F1), also where a cell is dealt out in
    parts; against the pairs themselves."""
    monkeypatch.setattr(graph, "CROWD", crowd)
    e, s = crowded(spark, places=12, copies=3)
    model = attention.start(attention.ENCODER, 3)
    heads, out, width = model[f"{name}.weight"].shape
    value = F.pmod(F.xxhash64("entity_id"), F.lit(7)) / 7
    g = graph.sheet_graph(e, s, e.select(*KEY, "entity_id", F.array(*[(value + F.lit(i % 5)) / 5 for i in range(width)]).alias("x")))
    assert (g.full.count() > 0) == (crowd == 3)
    x = {(r.revision, r.entity_id): np.array(r.x) for r in g.inputs().collect()}
    ends = g.nodes.select(*KEY, "entity_id")
    heard = {}
    for r in g.pairs(ends.withColumnRenamed("entity_id", "source"), ends.withColumnRenamed("entity_id", "target")).collect():
        heard.setdefault((r.revision, r.target), []).append((x[r.revision, r.source], r.n))
    want = {}
    for k, around in heard.items():
        parts = []
        for w, a, b in zip(model[f"{name}.weight"], model[f"{name}.source"], model[f"{name}.target"]):
            score = np.array([a @ w @ v + b @ w @ x[k] for v, _ in around])
            share = np.exp(np.where(score > 0, score, 0.2 * score)) * [n for _, n in around]
            parts.append(w @ sum(p * v for p, (v, _) in zip(share / share.sum(), around)))
        want[k] = np.concatenate(parts) + model[f"{name}.bias"]
    monkeypatch.setattr(graph.SheetGraph, "pairs", lambda *a: pytest.fail("a row for each pair"))
    got = {(r.revision, r.entity_id): r.x for r in attention.attend(g.inputs(), g, model, name).collect()}
    assert got.keys() == want.keys() == x.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def brute(old, new, reach):
    pairs = sorted((float(np.hypot(u - x, v - y)), i, j, g) for g, i, x, y in old for h, j, u, v in new if g == h)
    ends, out = set(), set()
    for d, i, j, g in pairs:
        if d <= reach and (0, i) not in ends and (1, j) not in ends:
            ends |= {(0, i), (1, j)}
            out.add((g, i, j))
    return out


@pytest.mark.parametrize("candidates,rounds", [(12, 20), (0, 0)])
def test_greedy_by_place(spark, monkeypatch, candidates, rounds):
    """Heaps of copies and many equal distances, in one radius and in many, by rounds and with the rest in order."""
    r = np.random.default_rng(3)
    some = lambda p, n, size: [(int(g), f"{p}{k:03}", float(x), float(y)) for k, (g, x, y) in enumerate(zip(r.integers(0, 2, n), *r.integers(0, size, (2, n))))]
    old, new = some("o", 150, 6) + some("p", 60, 40), some("n", 170, 6) + some("m", 40, 40)
    monkeypatch.setattr(assign, "CANDIDATES", candidates)
    if candidates == 0:
        old, new = old + [(5, f"q{k:04}", 1.0, float(k % 3)) for k in range(90)], new + [(5, f"r{k:04}", 2.0, float(k % 3)) for k in range(120)]
    whole = assign.greedy_of_classes
    monkeypatch.setattr(assign, "greedy_of_classes", lambda *a: whole(*a, rounds=rounds))
    a = spark.createDataFrame(old, "g int, old_id string, x double, y double")
    b = spark.createDataFrame(new, "g int, new_id string, x double, y double")
    found = assign.greedy_by_place(a, b, ["g"], F.lit(12.0)).collect()
    assert {(x.g, x.old_id, x.new_id) for x in found} == brute(old, new, 12.0) and len(found) == len({x.old_id for x in found})
    assert assign.greedy_by_place(a.where("false"), b, ["g"], F.lit(12.0)).count() == 0


def test_shortlist(spark, monkeypatch):
    """The first five of every query, as from all pairs: copies, sixth digits that tie, missing and odd vectors; no row for each pair."""
    r = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(300, 8)).round(3))]
    rows += [(300 + k, rows[k % 3][1]) for k in range(60)] + [(400 + k, [x + 1e-8 * k for x in rows[7][1]]) for k in range(30)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [1.0, 2.0]), (504, [0.0] * 8), (505, [3.0, 1.0]), (506, [float("inf")] + [0.0] * 7), (507, [])]
    v = written(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3))
    q = v.where("vec_id % 20 = 0 or vec_id > 499").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    first = lambda df: [tuple(map(repr, x)) for x in df.withColumn("rank", F.row_number().over(best)).where("rank <= 5").orderBy("query_id", "rank").collect()]
    plain = q.crossJoin(v).where("vec_id <> query_id").select("query_id", "vec_id", F.round(match.cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    for size in (10_000, 37):
        monkeypatch.setattr(match, "ROWS", size)
        found = written(match.shortlist(q, v, 5).select("query_id", "vec_id", F.round("dot", 6).alias("similarity")))
        assert first(found) == first(plain)
        assert size < 10_000 or found.count() < plain.count() / 4


def test_copies_match_in_order(spark):
    """Copies on both sides come to the rule of candidates as one row each, and are paired in the order of their names."""
    side = lambda c, n: written(spark.createDataFrame([(1, f"{c}{k:02}", 5.0) for k in range(n)], f"comparison_id int, {c}_entity_id string, {c}_x0 double"))

    def candidates(a, b, th):
        assert a.count() == b.count() == 1
        return a.join(b, "comparison_id").select("comparison_id", F.lit(0.0).alias("distance"), F.col("a_entity_id").alias("old_id"), F.col("b_entity_id").alias("new_id"))

    found = match._one_to_one(side("a", 40), side("b", 30), candidates, None).collect()
    assert sorted((x.old_id, x.new_id) for x in found) == [(f"a{k:02}", f"b{k:02}") for k in range(30)]


def test_queries_of_matches_work_out_no_changes(spark, monkeypatch):
    """Who asks for matches only does not pay for the changes (F17)."""
    import importlib

    plan = importlib.import_module("sheetdelta.plans.compare")
    monkeypatch.setattr(plan, "compute_deltas", lambda *a: pytest.fail("changes were worked out"))
    for name in ("match_attribute", "tier_counts", "unmatched_entities"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_tiles_are_counted_not_swept(spark, monkeypatch):
    """A box of a tile is not repeated for each slab that it spans (F14); only what cuts do not part is swept."""
    r = np.random.default_rng(6)
    boxes = [(int(g), float(x), float(y), float(x + w), float(y + h)) for g, x, y, w, h in zip(r.integers(0, 2, 900), *r.integers(0, 60, (2, 900)), *r.integers(0, 9, (2, 900)))]
    want = {g: len({(i, j) for k, x0, y0, x1, y1 in boxes if k == g for i in range(int(x0), int(x1)) for j in range(int(y0), int(y1))}) for g in (0, 1)}
    df = spark.createDataFrame(boxes, "g int, x0 double, y0 double, x1 double, y1 double")
    area = lambda: {x.g: x.area for x in report.union_area(df, ["g"]).collect()}
    with monkeypatch.context() as m:
        m.setattr(report, "_swept", lambda *a: pytest.fail("tiles were swept"))
        assert area() == want
    monkeypatch.setattr(report, "CUTS", 1)
    monkeypatch.setattr(report, "TILE", 12)
    assert area() == want


def test_changes_read_what_exact_matches_left(spark):
    """The changes are worked out from the sides that the exact tier left, not from all entities (F15)."""
    m = matched(fixtures.entities(spark, "/root/testdata/sf0.001"), fixtures.sheets(spark), registered=True)
    exact = m.matches.where("tier = 'exact'").count()
    sides = [m.entities.where(f"revision = '{rev}'").count() for rev in ("old", "new")]
    assert 0 < exact and [df.count() for df in m.rest] == [n - exact for n in sides]


def entity(rev, ordinal, x, y, text=None, anchor=None, kind="text"):
    shape = [("rect", [(x, y), (x + 8.0, y + 4.0)])] if kind == "linework" else []
    return (1, rev, ordinal, kind, shape, x, y, x + 8.0, y + 4.0, text, None, None, "#000000", None, 1.0, *(anchor or (None, None)), None, None)


def test_copies_of_a_place_are_one_class(spark, monkeypatch):
    """Different texts at one place are one class for the tier that reads no texts (F16), and pair in the order of their names."""
    rows = [entity(rev, k, 40.0, 40.0, f"{rev} {k}", (40.0, 44.0)) for rev in ("old", "new") for k in range(30)]
    e = written(with_identity(spark.createDataFrame(rows, ENTITY)))
    s = spark.createDataFrame([(1, 842.0, 595.0, 842.0, 595.0, 0.0, 0.0, 1.0, 0.0)], SHEET)
    whole, sizes = match.attribute_candidates, []
    monkeypatch.setattr(match, "attribute_candidates", lambda a, b, th: sizes.append((a.count(), b.count())) or whole(a, b, th))
    found = match.match_entities(e, s)[0].collect()
    names = lambda rev: sorted(x.entity_id for x in e.where(f"revision = '{rev}'").collect())
    assert sizes == [(1, 1)] and {x.tier for x in found} == {"attribute"}
    assert sorted((x.old_id, x.new_id) for x in found) == list(zip(names("old"), names("new")))


@pytest.mark.parametrize("scale", [1.0, 2.0])
def test_exact_with_anchors_on_one_side(spark, scale):
    """Where one side alone has an anchor the pair is measured between centres, on shifted and on scaled sheets (F16)."""
    far = (300.0, 400.0)
    rows = []
    for k, (a, b) in enumerate([(None, None), (far, None), (None, far), (far, far), (far, (-300.0, 0.0))]):
        x = 50.0 * k
        rows.append(entity("old", k, x, 10.0, f"T{k}", a and (x + a[0], a[1])))
        row = list(entity("new", k, x, 10.0, f"T{k}", b and (x + b[0], b[1])))
        rows.append(tuple(row[:5] + [v * scale for v in row[5:9]] + row[9:14] + [row[14] * scale] + [v and v * scale for v in row[15:17]] + row[17:]))
    e = written(with_identity(spark.createDataFrame(rows, ENTITY)))
    s = spark.createDataFrame([(1, 842.0, 595.0, 842.0 * scale, 595.0 * scale, 0.0, 0.0, scale, 0.0)], SHEET)
    if scale == 1.0:
        e = written(e.withColumn("signature", F.col("text_payload")))
    found = match.exact_candidates(*match.sides(e, s)).join(e.select(F.col("entity_id").alias("old_id"), "text_payload", "revision"), "old_id").where("revision = 'old'")
    assert sorted(x.text_payload for x in found.collect()) == ["T0", "T1", "T2", "T3"]
