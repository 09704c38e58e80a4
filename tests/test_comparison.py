"""Known answers and brute force for the comparison's operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetdelta.functions.geometry import location_bin
from sheetdelta.functions.identity import with_identity
from sheetdelta.functions.numbers import canonical, fixed, signed
from sheetdelta.functions.text import VALUE, capitalised, collapsed, colour_hex, parse_dimension
from sheetdelta.operators.assign import best_total, greedy_one_to_one
from sheetdelta.operators.delta import violations
from sheetdelta.operators.graph import knn
from sheetdelta.operators.jobs import expired
from sheetdelta.operators.match import similarity_histogram
from sheetdelta.operators.register import least_squares, quality, seeded_ransac, text_anchors
from sheetdelta.operators.report import canonical_reports, severity_label, summary_lines, summary_table, union_area
from sheetdelta.plans import fixtures, queries
from sheetdelta.plans.compare import compare
from sheetdelta.schema import ENTITY, SHEET


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_dimension_texts(spark):
    texts = ["D1 = 12 cm", " wall=3.5", "a b = 3", "x = y", "", "L=12°", "plain", "é = 7 mm"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    label, value = parse_dimension(F.col("t"))
    got = [tuple(r) for r in df.orderBy("i").select(label, value).collect()]
    assert got == [("D1", "12 cm"), ("wall", "3.5"), (None, None), (None, None), (None, None), ("L", "12°"), (None, None), ("é", "7 mm")]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, signed(lit(-410.0)), signed(lit(30.0)), signed(lit(0.5)), capitalised(lit("lineWORK")), collapsed(lit(" a \n b "))) == ("-410", "+30", "+0.5", "Linework", "a b")
    assert one(spark, colour_hex(lit(1.0), lit(0.5), lit(0.0))) == ("#ff8000",)
    assert one(spark, colour_hex(lit(1.0), lit(None).cast("double"), lit(0.0))) == (None,)


def test_numbers_as_text(spark):
    """Against Python's formatting: ties, near ties, large and small numbers."""
    import json
    import random

    r = random.Random(1)
    values = [0.0, -0.0, 0.25, 0.35, 12.5, 13.5, 0.15, 2.675, 1000.123456, 1234567.5, 999999.5, 99999.95, 1e-5, 1.5e-7, 0.0001, 100000.0, 1e6, 123456.5, 0.05, -0.04, 5e-7, 1.5e-6, 2.5e-6, 0.000105, 12345.678905, 1e7]
    values += [r.choice([-1, 1]) * r.randint(0, 10**9) / r.choice([4, 8, 20, 1000, 2000, 10**6, 2 * 10**6]) for _ in range(3000)]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-6, 8) for _ in range(3000)]
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in values], "v double").select(v, signed(v).alias("g"), fixed(v, 1).alias("f1"), fixed(v, 0).alias("f0"), canonical(v).alias("c")).collect()
    for x in rows:
        size = abs(x.v)
        sign = "-" if x.v < 0 else ""
        rounded = round(x.v, 6)
        assert (x.g, x.f1, x.f0) == (("-" if x.v < 0 else "+") + f"{size:g}", sign + f"{size:.1f}", sign + f"{size:.0f}"), x.v
        assert x.c == json.dumps(0.0 if rounded == 0 else rounded), x.v


def test_odd_numbers_as_text(spark):
    """Sizes beyond 64 bits and beyond exact decimals, and what is no number."""
    import json

    r = random.Random(2)
    values = [1e9, 1e9 + 0.05, 9007199254.740991, 9007199254.740993, 1e10, 12345678901.25, 1e13, 1e15 + 0.5, 2.0**53, 1e16, 1.5e16, 123456789012345678.0, 9e18, 1e19, 1e22, 1e300, 1.25e300, 1e100]
    values += [r.choice([-1, 1]) * r.uniform(1, 10) * 10.0 ** r.randint(9, 17) for _ in range(1500)]
    v = F.col("v")
    columns = [signed(v).alias("g"), fixed(v, 1).alias("f1"), fixed(v, 0).alias("f0"), fixed(v, 6).alias("f6"), canonical(v).alias("c")]
    rows = spark.createDataFrame([(x,) for x in values], "v double").select(v, *columns).collect()
    for x in rows:
        assert x.g == ("-" if x.v < 0 else "+") + f"{abs(x.v):g}", x.v
        assert x.c == json.dumps(round(x.v, 6)), x.v
        if abs(x.v) < 9e18:
            assert (x.f1, x.f0, x.f6) == (f"{x.v:.1f}", f"{x.v:.0f}", f"{x.v:.6f}"), x.v
        else:
            assert float(x.f0) == x.v and x.f1.endswith(".0")
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double").select(*columns).collect()
    assert [tuple(x) for x in odd] == [("+nan", "nan", "nan", "nan", None), ("+inf", "inf", "inf", "inf", None), ("-inf", "-inf", "-inf", "-inf", None), (None,) * 5]


def test_value_pattern():
    """A unit is needed, a sign of either kind is read."""
    import re

    assert [bool(re.match(VALUE, t)) for t in ("5 cm", "+5 cm", "-5.25%", "5", "5 °", "5 cm2", "")] == [True, True, True, False, False, False, False]


def test_greedy_chain(spark):
    """A chain of candidates with rising distances settles one pair a round; rounds do not bound it."""
    rows = [("c", float(2 * k), f"o{k:03}", f"n{k:03}") for k in range(60)] + [("c", float(2 * k + 1), f"o{k + 1:03}", f"n{k:03}") for k in range(59)]
    df = spark.createDataFrame(rows, "comparison_id string, distance double, old_id string, new_id string")
    want = {(f"o{k:03}", f"n{k:03}") for k in range(60)}
    for rounds in (2, 4):
        assert {(x.old_id, x.new_id) for x in greedy_one_to_one(df, rounds=rounds).collect()} == want


def test_location_bins(spark):
    for (x, y), want in {(1, 1): "upper left", (50, 50): "mid center", (99, 99): "lower right", (-5, 200): "lower left"}.items():
        c = [F.lit(float(v)) for v in (x, y, x, y, 100, 100)]
        assert one(spark, location_bin(*c)) == (want,)
    assert one(spark, location_bin(*[F.lit(0.0)] * 6)) == ("mid center",)


@pytest.mark.parametrize("pct,n,want", [(0, 0, "Low"), (4.9, 9, "Low"), (5, 1, "Medium"), (1, 10, "Medium"), (14.9, 49, "Medium"), (15, 1, "High"), (0, 50, "High")])
def test_severity(spark, pct, n, want):
    assert one(spark, severity_label(F.lit(float(pct)), F.lit(n))) == (want,)


def test_union_area(spark):
    boxes = [(1, 0, 0, 10, 10), (1, 20, 0, 30, 10), (2, 0, 0, 10, 10), (2, 5, 0, 15, 10), (3, 0, 0, 10, 10), (3, 2, 2, 4, 4), (4, 0, 0, 0, 5)]
    r = random.Random(1)
    many = []
    for _ in range(60):
        x, y = r.randint(0, 20), r.randint(0, 20)
        many.append((5, x, y, x + r.randint(0, 8), y + r.randint(0, 8)))
    df = spark.createDataFrame([(b[0], *map(float, b[1:])) for b in [*boxes, *many]], "g int, x0 double, y0 double, x1 double, y1 double")
    got = {x.g: x.area for x in union_area(df, ["g"]).collect()}
    grid = {(i, j) for _, x0, y0, x1, y1 in many for i in range(int(x0), int(x1)) for j in range(int(y0), int(y1))}
    assert got == {1: 200.0, 2: 150.0, 3: 100.0, 5: float(len(grid))}


def test_union_area_of_many(spark):
    """Small boxes, sheet-wide ones, a cluster in one spot and equal boxes, against a grid of unit cells; and a large sheet."""
    r = np.random.default_rng(3)
    side, rows = 400, []
    for g in range(3):
        n = 3_000 if g < 2 else 40
        x, y = r.integers(0, side - 60, n), r.integers(0, side - 60, n)
        w, h = r.integers(0, 12 if g == 0 else 60, n), r.integers(0, 12 if g == 0 else 60, n)
        some = np.column_stack([x, y, x + w, y + h]).tolist()
        if g == 1:
            some += [[0, k % 7, side - 100, k % 7 + 90] for k in range(300)] + [[5, 5, 6 + k % 9, 7 + k % 8] for k in range(2_000)]
        rows += [(g, *map(float, b)) for b in some]
    df = spark.createDataFrame(rows, "g int, x0 double, y0 double, x1 double, y1 double").repartition(4)
    got = {x.g: x.area for x in union_area(df, ["g"]).collect()}
    for g in range(3):
        grid = np.zeros((side, side), bool)
        for _, x0, y0, x1, y1 in (b for b in rows if b[0] == g):
            grid[int(x0) : int(x1), int(y0) : int(y1)] = True
        assert got[g] == grid.sum()
    # 60,000 boxes of one sheet on a lattice: every second cell.
    k = F.col("id")
    lattice = spark.range(60_000).select(F.lit(1).alias("g"), (k % 300 * 2.0).alias("x0"), (F.floor(k / 300) * 2.0).alias("y0"))
    lattice = lattice.withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    assert union_area(lattice, ["g"]).first().area == 60_000.0


def test_numbers_in_order(spark):
    """Large groups are numbered in ranges, with the same numbers as by a window."""
    from sheetdelta.operators.ranking import numbered, ranked

    rows = [(i % 3 if i % 5 else 7, (i * 37) % 101, i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(5)
    order = [F.desc("v"), F.asc("i")]
    a, b = (sorted(tuple(x) for x in numbered(df, "k", order, "n", most).select("k", "i", "n").collect()) for most in (10, 10_000))
    assert a == b and len(a) == 2_000
    r = sorted((x["rank"], x.v, x.i) for x in ranked(df, order).collect())
    assert [x[0] for x in r] == list(range(1, 2_001)) and [(v, i) for _, v, i in r] == sorted(((v, i) for _, v, i in rows), key=lambda x: (-x[0], x[1]))
    assert ranked(df.where("false"), order).count() == 0 and numbered(df.where("false"), "k", order).count() == 0


def test_drawn_hypotheses(spark):
    """Against a loop over the drawn pairs, anchor by anchor; a comparison whose anchors are ranked in ranges gives the same."""
    r = random.Random(9)
    rows = []
    for c in range(4):
        turn, shift = complex(0.9 + 0.2 * c, 0.3 * c), complex(20 * c, -7)
        for k in range(5 + 20 * c):
            o = complex(r.uniform(0, 800), r.uniform(0, 500))
            n = o * turn + shift if r.random() < 0.7 else complex(r.uniform(0, 800), r.uniform(0, 500))
            rows.append((c, "text" if k % 2 else "geometry", f"k{k:03}", o.real, o.imag, n.real, n.imag))
    rows += [(9, "text", "a", 0.0, 0.0, 1.0, 1.0), (9, "text", "b", 5.0, 0.0, 6.0, 1.0)]
    pairs = spark.createDataFrame(rows, "comparison_id int, source string, key string, ox double, oy double, nx double, ny double")
    sheets = spark.createDataFrame([(c, 842.0, 595.0, 842.0, 595.0, 0.0, 0.0, 1.0, 0.0) for c in (0, 1, 2, 3, 9)], SHEET)
    want, tol = {}, 0.005 * (842**2 + 595**2) ** 0.5
    for c in range(4):
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] != "text", x[2]))
        o, n = ([complex(x[i], x[i + 1]) for x in own] for i in (3, 5))
        draw, most = random.Random(1337), []
        for _ in range(200):
            i, j = draw.sample(range(len(o)), 2)
            a = (n[j] - n[i]) / (o[j] - o[i]) if o[i] != o[j] else 0
            inside = [k for k in range(len(o)) if abs(a * o[k] + n[i] - a * o[i] - n[k]) <= tol] if 0.2 <= abs(a) <= 5 else []
            most = inside if len(inside) > len(most) else most
        want[c] = len(most)
    for one_task in (1_000_000, 10):
        got = {x.comparison_id: x for x in seeded_ransac(pairs, sheets, one_task=one_task).collect()}
        assert {c: x.n for c, x in got.items()} == want
        assert abs(got[2].scale - abs(complex(1.3, 0.6))) < 1e-3


def test_greedy_is_global_greedy(spark):
    r = random.Random(2)
    rows = [(g, float(r.randint(0, 6)), f"o{r.randint(0, 9)}", f"n{r.randint(0, 9)}") for g in range(12) for _ in range(25)]
    rows = sorted(set(rows))
    got = {(x.comparison_id, x.old_id, x.new_id) for x in greedy_one_to_one(spark.createDataFrame(rows, "comparison_id int, distance double, old_id string, new_id string")).collect()}
    want, olds, news = set(), set(), set()
    for g, _, o, n in sorted(rows):
        if (g, o) not in olds and (g, n) not in news:
            olds.add((g, o))
            news.add((g, n))
            want.add((g, o, n))
    assert got == want


def test_best_total_is_optimal():
    r = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 5), (5, 3), (6, 6), (7, 4)]:
        for _ in range(20):
            s = np.round(r.uniform(-1, 1, (n, m)), 1)
            rows, cols = best_total(s)
            assert len(set(rows)) == len(set(cols)) == min(n, m)
            wide = s if n <= m else s.T
            best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
            assert abs(s[rows, cols].sum() - best) < 1e-9


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(5)
    pts = [(0, "old", f"e{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([r.uniform(0, 100, (60, 2)), r.normal(500, 1, (40, 2))]))]
    pts += [(1, "old", "a", 0.0, 0.0), (1, "old", "b", 0.0, 0.0), (2, "old", "alone", 5.0, 5.0)]
    df = spark.createDataFrame([(c, v, n, x, y, x, y) for c, v, n, x, y in pts], "comparison_id int, revision string, entity_id string, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for x in knn(df).orderBy("rank").collect():
        got.setdefault((x.comparison_id, x.entity_id), []).append(x.other_id)
    want = {}
    for c, _, n, x, y in pts:
        near = sorted((((u - x) ** 2 + (v - y) ** 2) ** 0.5, m) for d, _, m, u, v in pts if d == c and m != n)[:4]
        if near:
            want[c, n] = [m for _, m in near]
    assert got == want


def test_registration_recovers_rotation(spark):
    a, b = 1.5 * np.exp(0.3j), 20 - 7j
    r = np.random.default_rng(6)
    o = r.uniform(0, 500, 30) + 1j * r.uniform(0, 500, 30)
    n = a * o + b
    n[:6] += 100 + 50j
    rows = [(0, "text", f"k{i:02d}", p.real, p.imag, q.real, q.imag) for i, (p, q) in enumerate(zip(o, n))] + [(1, "text", "k", 0.0, 0.0, 1.0, 1.0)]
    pairs = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in x) for x in rows], "comparison_id int, source string, key string, ox double, oy double, nx double, ny double")
    sheets = spark.createDataFrame([(i, *[800.0, 600.0] * 2, 0.0, 0.0, 1.0, 0.0) for i in (0, 1)], SHEET)
    (f,) = seeded_ransac(pairs, sheets).collect()
    assert f.n == 24 and abs(f.scale - 1.5) < 1e-9 and abs(f.rotation - 0.3) < 1e-9 and abs(f.tx - 20) < 1e-6 and abs(f.ty + 7) < 1e-6
    (g,) = least_squares(pairs.where("key >= 'k06'"), ["comparison_id"]).where("comparison_id = 0").collect()
    assert abs(g.scale - 1.5) < 1e-9 and abs(g.rotation - 0.3) < 1e-9


def entity(c, rev, k, kind, box, text=None, label=None, value=None, width=1.0, geometry=None):
    x0, y0, x1, y1 = map(float, box)
    shape = [("rect", [(x0, y0), (x1, y1)])] if kind == "linework" and geometry is None else geometry or []
    anchor = (x0, y1) if kind != "linework" else (None, None)
    return (c, rev, k, kind, shape, x0, y0, x1, y1, text, label, value, "#000000", None, width, *anchor, None, None)


def sheet_pair(c, dx=0.0, dy=0.0, scale=1.0):
    """A small plan with a changed dimension, an added and a removed shape, and a restyled one."""
    base = [
        ("linework", (60, 60, 780, 540), None, 2.0), ("linework", (100, 100, 160, 180), None, 1.0), ("linework", (300, 90, 340, 95), None, 0.8), ("linework", (420, 400, 470, 480), None, 1.0),
        ("text", (120, 300, 180, 312), "KITCHEN", 1.0), ("text", (400, 300, 460, 312), "HALL", 1.0), ("text", (600, 120, 680, 132), "STUDY", 1.0), ("text", (610, 450, 660, 462), "BATH", 1.0),
    ]
    out = [entity(c, "old", i, k, b, t, width=w) for i, (k, b, t, w) in enumerate(base)]
    out.append(entity(c, "old", 20, "dimension", (200, 500, 260, 512), "W = 450 cm", "W", "450 cm"))
    move = lambda b: ((b[0] * scale + dx), (b[1] * scale + dy), (b[2] * scale + dx), (b[3] * scale + dy))
    new = [entity(c, "new", i, k, move(b), t, width=w * scale) for i, (k, b, t, w) in enumerate(base) if i != 2]
    new[2] = (*new[2][:14], new[2][14] + 1.0, *new[2][15:])
    new.append(entity(c, "new", 20, "dimension", move((200, 500, 260, 512)), "W = 40 cm", "W", "40 cm", width=scale))
    new.append(entity(c, "new", 30, "linework", move((700, 120, 750, 170)), width=1.2 * scale))
    return [*out, *new]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [*sheet_pair(0), *sheet_pair(1, 34.0, 21.0), *sheet_pair(2, 8.0, -4.0, 1.02)]
    sheets = [(i, 842.0, 595.0, 842.0, 595.0, 0.0, 0.0, 1.0, 0.0) for i in range(4)]
    alone = [entity(3, "old", 1, "text", (1, 1, 9, 9), "ONLY"), entity(3, "new", 1, "text", (500, 400, 520, 410), "OTHER")]
    e, s = spark.createDataFrame([*rows, *alone], ENTITY), spark.createDataFrame(sheets, SHEET)
    return s, compare(e, s)


def test_whole_comparison(pairs):
    _, c = pairs
    for i in range(3):
        got = sorted((d.change_type, ",".join(d.kinds)) for d in c.deltas.where(F.col("comparison_id") == i).collect())
        assert got == [("added", ""), ("modified", "style"), ("modified", "text,dimension_value"), ("removed", "")], i
    assert {r.comparison_id: r.outcome for r in c.outcomes.collect()} == {0: "changes_found", 1: "changes_found", 2: "changes_found", 3: "declined"}
    assert violations(c.deltas).count() == 0


def test_reports(pairs):
    s, c = pairs
    lines = {r.text for r in summary_lines(c.deltas.where("comparison_id = 0")).collect()}
    assert lines == {'Dimension "W" changed from "450 cm" to "40 cm".', "New linework entity added.", "Linework entity removed.", "Entity modified (style)."}
    table = summary_table(s, c.deltas).where("comparison_id = 0").orderBy("position").collect()
    assert [r.change for r in table] == ["CH-001", "CH-002", "CH-003", "CH-004"]
    assert {r.delta for r in table} == {"", "-410 cm"} and {r.confidence for r in table} == {""}
    texts = {r.comparison_id: r.report for r in canonical_reports(s, c.deltas).collect()}
    assert '"outcome":"no_changes"' in texts[3] and texts[0].count('"delta_id"') == 4


def test_histogram_labels(spark):
    df = spark.createDataFrame([(0, v) for v in (0.999, 1.0, -0.01, -1.0, 0.34)], "c int, similarity double")
    assert {r.bucket: r.n for r in similarity_histogram(df, ["c"]).collect()} == {"1.0": 2, "-0.0": 1, "-1.0": 1, "0.3": 1}


def test_expiry(spark):
    jobs = spark.sql(
        "SELECT * FROM VALUES (1, 'done', timestamp'2024-01-01', timestamp'2024-01-01'), (2, 'done', timestamp'2024-03-01', timestamp'2024-01-01'), "
        "(3, 'matching', timestamp'2024-01-01', timestamp'2024-01-01'), (4, null, null, timestamp'2024-01-01'), (5, null, null, timestamp'2024-02-01 00:00:00') t(job_id, state, expires_at, newest_file)"
    )
    assert {r.job_id for r in expired(jobs, F.lit("2024-02-01 10:00:00").cast("timestamp")).collect()} == {1, 4}


def greedy(pairs):
    """The pairs (comparison, distance, old, new) that one pass in order takes."""
    out, olds, news = set(), set(), set()
    for c, d, a, b in sorted(pairs):
        if (c, a) not in olds and (c, b) not in news:
            olds.add((c, a))
            news.add((c, b))
            out.add((c, a, b, round(d, 6)))
    return out


def test_greedy_on_every_sheet_and_kind(spark, data):
    e = with_identity(fixtures.entities(spark, data)).collect()
    old, new = ([r for r in e if r.revision == v] for v in ("old", "new"))
    near = [(a.comparison_id, float(np.sqrt((b.x0 - a.x0) ** 2 + (b.y0 - a.y0) ** 2)), a.entity_id, b.entity_id) for a in old for b in new if (a.comparison_id, a.kind) == (b.comparison_id, b.kind)]
    got = {(r.comparison_id, r.old_id, r.new_id, r.distance) for r in queries.match_greedy(spark, data).collect()}
    assert got == greedy(p for p in near if p[1] <= 60) and {c for c, *_ in got} == set(range(7))
    at = [(r, (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for r in old]
    near = [(a.comparison_id, float(np.sqrt((u + 2 - x) ** 2 + (v - y) ** 2)), a.entity_id, b.ordinal) for a, x, y in at for b, u, v in at if (a.comparison_id, a.kind) == (b.comparison_id, b.kind)]
    got = {(r.comparison_id, r.entity_id, r.record_id, r.distance) for r in queries.label_alignment(spark, data).collect()}
    assert got == greedy(p for p in near if p[1] <= 20.62) and {c for c, *_ in got} == set(range(7))


def test_consensus_uses_every_anchor(spark, data):
    anchors, sheets = text_anchors(with_identity(fixtures.entities(spark, data))).collect(), {s.comparison_id: s for s in fixtures.sheets(spark).collect()}
    groups = {}
    for r in anchors:
        k = int("".join(ch for ch in r.key.split(" ")[0] if ch.isdigit()))
        groups.setdefault(r.comparison_id + 7 * (k // 280), []).append(r)
    want = set()
    for c, rows in groups.items():
        rows.sort(key=lambda r: r.key)
        o, n = np.array([complex(r.ox, r.oy) for r in rows]), np.array([complex(r.nx, r.ny) for r in rows])
        tol, best = 0.005 * abs(complex(sheets[c % 7].new_width, sheets[c % 7].new_height)), None
        for i, j in itertools.combinations(range(len(rows)), 2):
            a = (n[j] - n[i]) / (o[j] - o[i]) if o[i] != o[j] else 0
            if 0.2 <= abs(a) <= 5:
                count = int((abs(a * o + (n[i] - a * o[i]) - n) <= tol).sum())
                best = max(best or (0,), (count, -i - 1, -j - 1))
        want.add((c, -best[1], -best[2], best[0]))
    assert {tuple(r) for r in queries.consensus_all_pairs(spark, data).collect()} == want and {c % 7 for c, *_ in want} == set(range(7))
    assert {r.comparison_id for r in queries.seeded_ransac(spark, data).collect()} == set(range(7))
    assert {r.comparison_id for r in queries.fit_similarity_ls(spark, data).collect()} == set(range(7))


def test_sheet_without_anchors_fails(spark, data):
    anchors = text_anchors(with_identity(fixtures.entities(spark, data)))
    sheets = fixtures.sheets(spark)
    got = {r.comparison_id: r for r in quality(anchors.where("comparison_id <> 3"), sheets, sheets).collect()}
    assert set(got) == set(range(7)) and (got[3].anchors, got[3].inlier_ratio, got[3].rms_rel, got[3].status) == (0, 0.0, 1.0, "failed")
    assert {c for c, r in got.items() if r.status == "aligned"} == {0, 1, 2, 4, 5, 6}
    assert {r.comparison_id for r in queries.registration_quality(spark, data).where("status = 'aligned'").collect()} == set(range(7))


def test_fixture_rules(spark, data):
    e = fixtures.entities(spark, data)
    assert e.where("revision = 'old'").count() == spark.read.parquet(f"{data}/part.parquet").count()
    assert e.groupBy("comparison_id", "revision", "ordinal").count().where("count > 1").count() == 0


def test_moved_vs_removed(spark, data):
    """Moves are found by similarity and carry it; what is too far apart is one entity gone and one come."""
    rows = queries.QUERIES["moved_vs_removed"](spark, data).collect()
    learned = [r for r in rows if r.tier == "learned"]
    assert learned and all(r.change_type == "modified" and "moved" in r.kinds and r.confidence == "100%" for r in learned)
    parts = spark.read.parquet(f"{data}/part.parquet").count()
    named = [k for k in range(1, parts + 1) if k % 19 == 0 and k % 17 and k % 4 >= 2]
    assert len([r for r in learned if r.entity in ("text", "dimension")]) == len(named)
    assert any(r.change_type == "removed" and "type \"" in r.text for r in rows) and any("(" in r.entity for r in rows)
    assert not [r for r in rows if r.change_type != "modified" and r.confidence]


def test_overlap_after_a_turn(spark):
    """Matching takes the transformed corners as they come; a half turn swaps them, so equal boxes do not overlap there."""
    from sheetdelta.functions.geometry import iou, mapped_box, mapped_corners

    row = {"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 4.0}
    for rotation, tx, ty, want in ((0.0, 0.0, 0.0, (1.0, 1.0)), (float(np.pi), 10.0, 4.0, (0.0, 1.0)), (float(np.pi / 2), 4.0, 0.0, (0.0, None))):
        t = {"tx": F.lit(tx), "ty": F.lit(ty), "scale": F.lit(1.0), "rotation": F.lit(rotation)}.__getitem__
        e = {k: F.lit(v) for k, v in row.items()}.__getitem__
        box = tuple(F.lit(v) for v in (0.0, 0.0, 10.0, 4.0))
        raw, sorted_ = one(spark, iou(mapped_corners(e, t), box).alias("a"), iou(mapped_box(e, t), box).alias("b"))
        assert abs(raw - want[0]) < 1e-9 and (want[1] is None or abs(sorted_ - want[1]) < 1e-9)


def test_job_log(spark, tmp_path):
    """The log of one of two comparisons holds its counts and no line of the other's."""
    from sheetdelta.operators import joblog
    from sheetdelta.operators.match import unmatched
    from sheetdelta.plans import synth

    e = synth.pair(spark, ["dim-change", "add", "remove"]).union(synth.pair(spark, ["style"], comparison_id=1))
    c = compare(e, synth.sheets(spark, [0, 1]))
    labelled = c.entities.withColumn("semantic_confidence", F.when(F.col("ordinal") < 2, 0.4).otherwise(0.9))
    signals = joblog.stage_signals(c.entities, c.matches, c.deltas, unmatched(c.entities, c.matches), c.registrations, labelled)
    joblog.write_log(signals, str(tmp_path / "log"))
    got = {x.stage: x.signals for x in joblog.read_log(spark, str(tmp_path / "log"), 0).collect()}
    assert got["diffing"] == {"added": 1, "modified": 1, "removed": 1}
    assert got["matching"]["unmatched_old"] == got["matching"]["unmatched_new"] == 1 and got["classifying"] == {"low_confidence": 4}
    assert got["extracting"] == {"entities_new": 22, "entities_old": 22} and got["registering"]["anchors"] >= 3
    other = joblog.read_log(spark, str(tmp_path / "log"), 1).collect()
    assert {x.comparison_id for x in other} == {1} and [x.signals for x in other if x.stage == "diffing"] == [{"modified": 1}]
    assert joblog.read_log(spark, str(tmp_path / "log"), 5).count() == 0
