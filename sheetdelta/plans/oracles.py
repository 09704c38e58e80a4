"""SQL with the same rows as the queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.text import DIMENSION, VALUE
from .fixtures import _BASE, ENTITIES_SQL, SHEETS_SQL

_S = f"sheets AS ({SHEETS_SQL})"
_E = f"""{_S}, ent AS ({ENTITIES_SQL}),
sig AS (SELECT *, CASE WHEN kind = 'linework' THEN 'rect|' || printf('%.3f,%.3f', -(x1 - x0) / 2, -(y1 - y0) / 2) || '|' || printf('%.3f,%.3f', (x1 - x0) / 2, (y1 - y0) / 2) END AS shp FROM ent),
sgn AS (SELECT *, substr(sha1(concat_ws('|', kind, stroke, '', printf('%.3f', width), text_payload, shp)), 1, 16) AS signature FROM sig),
bas AS (SELECT *, substr(sha1(signature || '@' || printf('%.3f,%.3f', x0, y0)), 1, 12) AS base FROM sgn),
e AS (SELECT *, 'e-' || base || CASE WHEN row_number() OVER (PARTITION BY comparison_id, revision, base ORDER BY round(y0, 3), round(x0, 3), signature, ordinal) > 1
   THEN '-' || (row_number() OVER (PARTITION BY comparison_id, revision, base ORDER BY round(y0, 3), round(x0, 3), signature, ordinal) - 1) ELSE '' END AS entity_id FROM bas)"""

_DIST = "sqrt(power(coalesce(b.anchor_x, (b.x0 + b.x1) / 2) - (coalesce(a.anchor_x, (a.x0 + a.x1) / 2) * scale + tx), 2) + power(coalesce(b.anchor_y, (b.y0 + b.y1) / 2) - (coalesce(a.anchor_y, (a.y0 + a.y1) / 2) * scale + ty), 2))"
_SHAPE = "(a.kind = b.kind AND (a.kind <> 'linework' OR CASE WHEN scale = 1 THEN a.shp = b.shp ELSE abs((a.x1 - a.x0) / 2 * scale - (b.x1 - b.x0) / 2) <= 0.001 * diag AND abs((a.y1 - a.y0) / 2 * scale - (b.y1 - b.y0) / 2) <= 0.001 * diag END))"
_STYLE = "(abs(a.width - b.width) <= 1e-6 OR scale <> 1 AND abs(b.width - a.width * scale) <= 0.05 * greatest(b.width, a.width * scale))"


def _greedy(name: str, candidates: str) -> str:
    return f"""{name}_c AS ({candidates}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY distance, old_id, new_id) AS rn FROM {name}_c),
{name}_w AS (SELECT comparison_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS o, CAST([] AS VARCHAR[]) AS n, CAST(NULL AS VARCHAR) AS old_id, CAST(NULL AS VARCHAR) AS new_id, CAST(NULL AS DOUBLE) AS distance
  FROM (SELECT DISTINCT comparison_id FROM {name}_c)
  UNION ALL
  SELECT w.comparison_id, c.rn, CASE WHEN c.old_id IN (SELECT unnest(w.o)) OR c.new_id IN (SELECT unnest(w.n)) THEN w.o ELSE list_append(w.o, c.old_id) END,
    CASE WHEN c.old_id IN (SELECT unnest(w.o)) OR c.new_id IN (SELECT unnest(w.n)) THEN w.n ELSE list_append(w.n, c.new_id) END,
    CASE WHEN list_contains(w.o, c.old_id) OR list_contains(w.n, c.new_id) THEN NULL ELSE c.old_id END,
    CASE WHEN list_contains(w.o, c.old_id) OR list_contains(w.n, c.new_id) THEN NULL ELSE c.new_id END, c.distance
  FROM {name}_w w JOIN {name}_r c ON c.comparison_id = w.comparison_id AND c.rn = w.rn + 1),
{name} AS (SELECT comparison_id, old_id, new_id, distance FROM {name}_w WHERE old_id IS NOT NULL)""".replace(
        "c.old_id IN (SELECT unnest(w.o)) OR c.new_id IN (SELECT unnest(w.n))", "list_contains(w.o, c.old_id) OR list_contains(w.n, c.new_id)"
    )


_SIDES = f"""{_E}, sh AS (SELECT *, sqrt(new_width * new_width + new_height * new_height) AS diag FROM sheets),
a AS (SELECT e.*, diag, scale, tx, ty FROM e JOIN sh USING (comparison_id) WHERE revision = 'old'), b AS (SELECT * FROM e WHERE revision = 'new')"""
_T1 = f"""SELECT a.comparison_id, a.entity_id AS old_id, b.entity_id AS new_id, {_DIST} AS distance FROM a JOIN b ON a.comparison_id = b.comparison_id AND a.kind = b.kind
  WHERE {_DIST} <= 0.001 * diag AND CASE WHEN scale = 1 THEN a.signature = b.signature ELSE a.text_payload IS NOT DISTINCT FROM b.text_payload AND {_SHAPE} AND {_STYLE} END"""
_IW = "(least(a.x1 * scale + tx, b.x1) - greatest(a.x0 * scale + tx, b.x0))"
_IH = "(least(a.y1 * scale + ty, b.y1) - greatest(a.y0 * scale + ty, b.y0))"
_IOU = f"(CASE WHEN {_IW} <= 0 OR {_IH} <= 0 THEN 0 ELSE {_IW} * {_IH} / ((a.x1 - a.x0) * (a.y1 - a.y0) * scale * scale + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IW} * {_IH}) END)"
_T2 = f"""SELECT a.comparison_id, a.entity_id AS old_id, b.entity_id AS new_id, {_DIST} AS distance
  FROM (SELECT * FROM a WHERE (comparison_id, entity_id) NOT IN (SELECT (comparison_id, old_id) FROM t1)) a
  JOIN (SELECT * FROM b WHERE (comparison_id, entity_id) NOT IN (SELECT (comparison_id, new_id) FROM t1)) b ON a.comparison_id = b.comparison_id AND a.kind = b.kind
  WHERE CASE WHEN a.kind <> 'linework' THEN {_DIST} <= 0.01 * diag ELSE {_DIST} <= 0.01 * diag AND {_SHAPE} OR {_IOU} >= 0.8 END"""
_MATCH = f"""{_SIDES}, {_greedy("t1", _T1)}, {_greedy("t2", _T2)},
m AS (SELECT comparison_id, old_id, new_id, 'exact' AS tier FROM t1 UNION ALL SELECT comparison_id, old_id, new_id, 'attribute' FROM t2),
alone AS (SELECT comparison_id, revision, entity_id FROM e WHERE CASE WHEN revision = 'old' THEN (comparison_id, entity_id) NOT IN (SELECT (comparison_id, old_id) FROM m)
  ELSE (comparison_id, entity_id) NOT IN (SELECT (comparison_id, new_id) FROM m) END)"""
_KINDS = f"""array_to_string(list_filter([CASE WHEN {_DIST} > 0.001 * diag THEN 'moved' END, CASE WHEN NOT {_SHAPE} THEN 'geometry' END,
  CASE WHEN a.text_payload IS DISTINCT FROM b.text_payload THEN 'text' END, CASE WHEN a.dimension_value IS DISTINCT FROM b.dimension_value THEN 'dimension_value' END,
  CASE WHEN NOT {_STYLE} THEN 'style' END], lambda k: k IS NOT NULL), ',')"""
_AB = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in ("kind", "text_payload", "label", "dimension_value", "x0", "y0", "x1", "y1"))
_A0 = ", ".join(f"a.{c}, NULL" for c in ("kind", "text_payload", "label", "dimension_value", "x0", "y0", "x1", "y1"))
_B0 = ", ".join(f"NULL, b.{c}" for c in ("kind", "text_payload", "label", "dimension_value", "x0", "y0", "x1", "y1"))
_DELTA = f"""{_MATCH}, d0 AS (
SELECT m.comparison_id, 'modified' AS change_type, {_KINDS} AS kinds, tier, old_id, new_id, b.x0, b.y0, b.x1, b.y1, {_AB}
  FROM m JOIN a ON a.comparison_id = m.comparison_id AND a.entity_id = old_id JOIN b ON b.comparison_id = m.comparison_id AND b.entity_id = new_id WHERE tier <> 'exact' AND {_KINDS} <> ''
UNION ALL SELECT a.comparison_id, 'removed', '', NULL, a.entity_id, NULL, a.x0 * scale + tx, a.y0 * scale + ty, a.x1 * scale + tx, a.y1 * scale + ty, {_A0}
  FROM a JOIN alone n ON n.revision = 'old' AND n.comparison_id = a.comparison_id AND n.entity_id = a.entity_id
UNION ALL SELECT b.comparison_id, 'added', '', NULL, NULL, b.entity_id, b.x0, b.y0, b.x1, b.y1, {_B0}
  FROM b JOIN alone n ON n.revision = 'new' AND n.comparison_id = b.comparison_id AND n.entity_id = b.entity_id),
d AS (SELECT *, 'd-' || substr(sha1(change_type || '|' || coalesce(old_id, '') || '|' || coalesce(new_id, '')), 1, 10) AS delta_id, coalesce(b_kind, a_kind) AS kind FROM d0),
p AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY change_type, y0, x0, delta_id) AS position FROM d)"""
_AREA = """xs AS (SELECT DISTINCT comparison_id, unnest([x0, x1]) AS x FROM d), ys AS (SELECT DISTINCT comparison_id, unnest([y0, y1]) AS y FROM d),
xi AS (SELECT comparison_id, x, lead(x) OVER (PARTITION BY comparison_id ORDER BY x) AS nx FROM xs), yi AS (SELECT comparison_id, y, lead(y) OVER (PARTITION BY comparison_id ORDER BY y) AS ny FROM ys),
area AS (SELECT comparison_id, sum((nx - x) * (ny - y)) AS area FROM xi JOIN yi USING (comparison_id) WHERE nx IS NOT NULL AND ny IS NOT NULL
  AND EXISTS (SELECT 1 FROM d WHERE d.comparison_id = xi.comparison_id AND d.x0 <= x AND d.x1 >= nx AND d.y0 <= y AND d.y1 >= ny) GROUP BY comparison_id),
n AS (SELECT comparison_id, count(*) AS total, count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'removed') AS removed,
  count(*) FILTER (WHERE change_type = 'modified') AS modified, count(*) FILTER (WHERE change_type = 'modified' AND kind = 'dimension') AS dims FROM d GROUP BY comparison_id),
sv AS (SELECT comparison_id, coalesce(total, 0) AS changes, coalesce(area, 0) AS area, 100.0 * coalesce(area, 0) / (new_width * new_height) AS pct FROM sheets LEFT JOIN n USING (comparison_id) LEFT JOIN area USING (comparison_id)),
svl AS (SELECT *, CASE WHEN pct >= 15 OR changes >= 50 THEN 'High' WHEN pct >= 5 OR changes >= 10 THEN 'Medium' ELSE 'Low' END AS severity FROM sv)"""
_WHERE9 = "(['upper', 'mid', 'lower'])[1 + greatest(0, least(2, CAST(trunc({y} / {h} * 3) AS INT)))] || ' ' || (['left', 'center', 'right'])[1 + greatest(0, least(2, CAST(trunc({x} / {w} * 3) AS INT)))]"
_CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"
_OLD, _NEW = "coalesce(a_dimension_value, a_text_payload, '')", "coalesce(b_dimension_value, b_text_payload, '')"
_V = VALUE.replace("'", "''")
_NUM = f"(CAST(regexp_extract(b_dimension_value, '{_V}', 1) AS DOUBLE) - CAST(regexp_extract(a_dimension_value, '{_V}', 1) AS DOUBLE))"
_Q = "coalesce('\"' || nullif({0}, '') || '\"', 'value unavailable')"
_KL = "replace(kinds, ',', ', ')"

#: The answer key of the derived sheets, read by both engines; without a learned tier a long move is one entity gone and one come.
KEY_SQL = f"""
SELECT comparison_id, row_number() OVER (ORDER BY change_type, k) AS key_id, change_type, kind, x0, y0, x1, y1, old_value, new_value FROM (
  SELECT k, comparison_id, kind, change_type, (bx + dx + tx) * f AS x0, (yy + dy + ty) * f AS y0, (bx + dx + w + tx) * f AS x1, (yy + dy + h + ty) * f AS y1,
    CASE WHEN kind = 'dimension' AND change_type <> 'added' THEN concat(size, ' cm') END AS old_value,
    CASE WHEN kind = 'dimension' AND change_type <> 'removed' THEN concat(CASE WHEN change_type = 'modified' AND k % 23 = 0 THEN size + 1 ELSE size END, ' cm') END AS new_value
  FROM (SELECT b.*, CAST(CASE WHEN comparison_id % 2 = 1 THEN 8 ELSE 0 END AS DOUBLE) AS tx, CAST(CASE WHEN comparison_id % 2 = 1 THEN -4 ELSE 0 END AS DOUBLE) AS ty,
      CAST(CASE WHEN comparison_id = 6 THEN 2 ELSE 1 END AS DOUBLE) AS f, change_type, dx, dy
    FROM ({_BASE}) b JOIN (
      SELECT 1 AS rule, 'removed' AS change_type, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy
      UNION ALL SELECT 2, 'removed', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT 2, 'added', CAST(20 AS DOUBLE), CAST(0 AS DOUBLE)
      UNION ALL SELECT 3, 'modified', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT 4, 'added', CAST(0 AS DOUBLE), CAST(300 AS DOUBLE)) r
    ON (rule = 1 AND k % 17 = 0) OR (rule = 2 AND k % 17 <> 0 AND k % 19 = 0) OR (rule = 4 AND k % 31 = 0)
      OR (rule = 3 AND k % 17 <> 0 AND k % 19 <> 0 AND (k % 23 = 0 AND kind = 'dimension' OR k % 29 = 0))) x) y
"""

_BOXES = "SELECT comparison_id, revision, entity_id, x0, y0, x1, y1, 0.001 * CASE WHEN revision = 'old' THEN sqrt(old_width * old_width + old_height * old_height) ELSE sqrt(new_width * new_width + new_height * new_height) END AS tol FROM e JOIN sheets USING (comparison_id)"
_TOUCH = f"""{_E}, bx AS ({_BOXES}), touch AS (SELECT a.comparison_id, a.revision, a.entity_id AS source, b.entity_id AS target FROM bx a JOIN bx b
  ON a.comparison_id = b.comparison_id AND a.revision = b.revision AND a.entity_id < b.entity_id AND b.x0 <= a.x1 + a.tol AND b.x1 >= a.x0 - a.tol AND b.y0 <= a.y1 + a.tol AND b.y1 >= a.y0 - a.tol),
both_ways AS (SELECT comparison_id, revision, source, target FROM touch UNION SELECT comparison_id, revision, target, source FROM touch)"""
_FEATURES = f"""{_E}, fe AS (SELECT e.*, CASE WHEN revision = 'old' THEN old_width ELSE new_width END AS sw, CASE WHEN revision = 'old' THEN old_height ELSE new_height END AS sh, coalesce(text_payload, '') AS t FROM e JOIN sheets USING (comparison_id)),
ff AS (SELECT comparison_id, revision, entity_id, CAST(kind = 'linework' AS DOUBLE) AS is_linework, CAST(kind = 'text' AS DOUBLE) AS is_text, CAST(kind = 'dimension' AS DOUBLE) AS is_dimension,
  CAST(0 AS DOUBLE) AS is_symbol, CAST(0 AS DOUBLE) AS is_hatch, (x1 - x0) / sqrt(sw * sw + sh * sh) AS w, (y1 - y0) / sqrt(sw * sw + sh * sh) AS h, least((x1 - x0) / (y1 - y0 + 1e-6), 10) / 10 AS aspect,
  CASE WHEN kind = 'linework' THEN 0.1 ELSE 0 END AS segments, CAST(0 AS DOUBLE) AS lines, CAST(kind = 'linework' AS DOUBLE) AS rects, CAST(0 AS DOUBLE) AS curves, least(width, 20) / 20 AS stroke_width,
  CAST(t <> '' AS DOUBLE) AS has_text, least(length(t), 32) / 32 AS text_length, CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t) END AS digits,
  CASE WHEN t = '' THEN 0 ELSE length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(t) END AS uppers, (x0 + x1) / 2 / sw AS px, (y0 + y1) / 2 / sh AS py FROM fe)"""
_FEATURE_NAMES = "is_linework is_text is_dimension is_symbol is_hatch w h aspect segments lines rects curves stroke_width has_text text_length digits uppers px py".split()
_ANCHOR = f"""{_E}, rp AS (SELECT *, coalesce(anchor_x, (x0 + x1) / 2) AS rx, coalesce(anchor_y, (y0 + y1) / 2) AS ry, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
  count(*) OVER (PARTITION BY comparison_id, revision, text_payload) AS nt, count(*) OVER (PARTITION BY comparison_id, revision, kind, signature) AS ns FROM e),
ta AS (SELECT a.comparison_id, 'text' AS source, a.text_payload AS key, a.rx AS ox, a.ry AS oy, b.rx AS nx, b.ry AS ny FROM rp a JOIN rp b USING (comparison_id, text_payload)
  WHERE a.revision = 'old' AND b.revision = 'new' AND a.nt = 1 AND b.nt = 1),
ga AS (SELECT a.comparison_id, 'geometry' AS source, a.signature AS key, a.cx AS ox, a.cy AS oy, b.cx AS nx, b.cy AS ny FROM rp a JOIN rp b USING (comparison_id, signature)
  WHERE a.revision = 'old' AND b.revision = 'new' AND a.ns = 1 AND b.ns = 1 AND a.kind = 'linework' AND b.kind = 'linework')"""

#: The same anchors with every sheet read as many small ones.
_PARTS = _ANCHOR.replace("FROM e),", "FROM (SELECT * REPLACE (CAST(comparison_id + 7 * (ordinal // 2 // 280) AS INT) AS comparison_id) FROM e)),")


def _ls(x: str) -> str:
    return f"""SELECT comparison_id, count(*) AS n, sum((ox - mox) * (nx - mnx) + (oy - moy) * (ny - mny)) / sum(power(ox - mox, 2) + power(oy - moy, 2)) AS a,
  sum((ox - mox) * (ny - mny) - (oy - moy) * (nx - mnx)) / sum(power(ox - mox, 2) + power(oy - moy, 2)) AS b, any_value(mox) AS mox, any_value(moy) AS moy, any_value(mnx) AS mnx, any_value(mny) AS mny
  FROM (SELECT *, avg(ox) OVER w AS mox, avg(oy) OVER w AS moy, avg(nx) OVER w AS mnx, avg(ny) OVER w AS mny FROM {x} WINDOW w AS (PARTITION BY comparison_id)) GROUP BY comparison_id"""


_JOBS = """j AS (SELECT event_id AS job_id, CASE WHEN event_id % 11 <> 0 THEN (['pending','matching','done','failed','rejected','declined'])[1 + event_id % 6] END AS state, ts + INTERVAL 1 DAY AS expires_at, ts AS newest_file FROM events),
gone AS (SELECT * FROM j WHERE CASE WHEN state IS NULL THEN newest_file < TIMESTAMP '2024-01-14 12:00:00' ELSE state IN ('done','failed','rejected','declined') AND expires_at < TIMESTAMP '2024-01-15 12:00:00' END)"""
_DIM = DIMENSION.removeprefix("(?U)").replace("'", "''")
_SQL_R = "WITH RECURSIVE "

ORACLES: dict[str, str] = {
    "validate_inputs": """
WITH c AS (SELECT page_id AS id, CASE WHEN page_id % 13 = 0 THEN 'unsupported_format' WHEN page_id % 17 = 0 THEN 'file_too_large' WHEN page_id % 7 = 0 THEN 'unsupported_format'
  WHEN page_id % 19 = 0 OR page_id % 23 = 0 OR page_id % 5 >= 4 THEN 'unreadable' WHEN page_id % 3 = 0 AND page_id % 4 = 0 THEN 'raster_or_empty' END AS reason FROM pages)
SELECT id // 2 AS comparison_id, min_by(CASE WHEN id % 2 = 0 THEN 'old' ELSE 'new' END, id % 2) AS role, min_by(reason, id % 2) AS reason FROM c WHERE reason IS NOT NULL GROUP BY 1""",
    "extract_dimensions": f"""WITH {_E} SELECT comparison_id, revision, ordinal, CASE WHEN regexp_matches(text_payload, '{_DIM}') THEN trim(regexp_extract(text_payload, '{_DIM}', 1)) END AS label,
  CASE WHEN regexp_matches(text_payload, '{_DIM}') THEN trim(regexp_extract(text_payload, '{_DIM}', 2)) END AS value FROM e WHERE kind <> 'linework'""",
    "colour_codes": "SELECT p_partkey, printf('#%02x%02x%02x', p_partkey * 7 % 256, p_partkey * 11 % 256, p_partkey * 13 % 256) AS colour FROM part",
    "entity_ids": f"WITH {_E} SELECT comparison_id, revision, ordinal, signature, entity_id, CASE WHEN kind = 'linework' THEN substr(sha1(shp), 1, 16) ELSE 'kindonly:' || kind END AS shape FROM e",
    "reference_points": f"""WITH {_E} SELECT comparison_id, ordinal, coalesce(anchor_x, (x0 + x1) / 2) * scale + tx AS x, coalesce(anchor_y, (y0 + y1) / 2) * scale + ty AS y,
  {_WHERE9.format(x="((x0 + x1) / 2)", y="((y0 + y1) / 2)", w="old_width", h="old_height")} AS location FROM e JOIN sheets USING (comparison_id) WHERE revision = 'old'""",
    "inventory": f"""WITH {_E} SELECT comparison_id, revision, count(*) FILTER (WHERE kind = 'linework') AS linework, count(*) FILTER (WHERE kind = 'text') AS text, count(*) FILTER (WHERE kind = 'dimension') AS dimension,
  string_agg(text_payload, '|' ORDER BY text_payload) AS texts FROM e GROUP BY ALL""",
    "entity_features": f"WITH {_FEATURES} SELECT comparison_id, revision, entity_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _FEATURE_NAMES)} FROM ff",
    "knn_edges": f"""WITH {_E}, c AS (SELECT comparison_id, revision, entity_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM e),
r AS (SELECT a.comparison_id, a.revision, a.entity_id, b.entity_id AS other, row_number() OVER (PARTITION BY a.comparison_id, a.revision, a.entity_id ORDER BY sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)), b.entity_id) AS n
  FROM c a JOIN c b ON a.comparison_id = b.comparison_id AND a.revision = b.revision AND a.entity_id <> b.entity_id)
SELECT DISTINCT comparison_id, revision, least(entity_id, other) AS source, greatest(entity_id, other) AS target, 'knn-proximity' AS edge_kind FROM r WHERE n <= 4""",
    "touch_edges": f"WITH {_TOUCH} SELECT *, 'connectivity' AS edge_kind FROM touch",
    "edge_degrees": f"WITH {_TOUCH} SELECT comparison_id, revision, source AS entity_id, count(*) AS degree FROM both_ways GROUP BY ALL",
    "neighbour_aggregate": f"""WITH {_FEATURES}, bx AS ({_BOXES}), {_TOUCH.split(f"bx AS ({_BOXES}), ")[1]}
SELECT f.comparison_id, f.revision, f.entity_id, {', '.join(f'round(coalesce(avg(g.{c}), 0), 6) AS m_{c}' for c in ("w", "h", "stroke_width"))}
FROM ff f LEFT JOIN both_ways t ON t.comparison_id = f.comparison_id AND t.revision = f.revision AND t.source = f.entity_id
LEFT JOIN ff g ON g.comparison_id = t.comparison_id AND g.revision = t.revision AND g.entity_id = t.target GROUP BY ALL""",
    "cosine_pairs": """SELECT a.label, a.vec_id, b.vec_id AS other, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 40""",
    "text_anchors": f"WITH {_ANCHOR} SELECT * FROM ta",
    "geometry_anchors": f"WITH {_ANCHOR.replace('FROM e),', 'FROM (SELECT * REPLACE (CAST(comparison_id * 100 + ordinal // 2 % 50 AS INT) AS comparison_id) FROM e)),')} SELECT * FROM ga",
    "fit_similarity_ls": f"""WITH {_ANCHOR}, f AS ({_ls("ta")}) SELECT comparison_id, n, round(sqrt(a * a + b * b), 4) AS scale, round(atan2(b, a), 4) + 0.0 AS rotation,
  round(mnx - (a * mox - b * moy), 4) AS tx, round(mny - (b * mox + a * moy), 4) AS ty FROM f""",
    "registration_quality": f"""WITH {_ANCHOR}, q AS (SELECT comparison_id, count(*) AS anchors, avg(CAST(err <= 0.005 * diag AS INT)) AS ratio, sqrt(avg(err * err) FILTER (WHERE err <= 0.005 * diag)) / any_value(diag) AS rms
  FROM (SELECT *, sqrt(power(ox * scale + tx - nx, 2) + power(oy * scale + ty - ny, 2)) AS err, sqrt(new_width * new_width + new_height * new_height) AS diag FROM ta JOIN sheets USING (comparison_id)) GROUP BY comparison_id)
SELECT comparison_id, coalesce(anchors, 0) AS anchors, round(coalesce(ratio, 0), 6) AS inlier_ratio, round(coalesce(rms, 1), 4) AS rms_rel,
  CASE WHEN anchors >= 3 AND ratio >= 0.6 AND rms <= 0.005 THEN 'aligned' ELSE 'failed' END AS status FROM sheets LEFT JOIN q USING (comparison_id)""",
    "consensus_all_pairs": f"""WITH {_PARTS}, p AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY key) AS i FROM ta),
h AS (SELECT p.comparison_id, p.i, q.i AS i2, ((q.ox - p.ox) * (q.nx - p.nx) + (q.oy - p.oy) * (q.ny - p.ny)) / (power(q.ox - p.ox, 2) + power(q.oy - p.oy, 2)) AS a,
  ((q.ox - p.ox) * (q.ny - p.ny) - (q.oy - p.oy) * (q.nx - p.nx)) / (power(q.ox - p.ox, 2) + power(q.oy - p.oy, 2)) AS b, p.ox, p.oy, p.nx, p.ny FROM p JOIN p q ON p.comparison_id = q.comparison_id AND p.i < q.i WHERE p.ox <> q.ox OR p.oy <> q.oy),
g AS (SELECT h.comparison_id, h.i, h.i2, a, b, nx - a * ox + b * oy AS c, ny - b * ox - a * oy AS d FROM h WHERE sqrt(a * a + b * b) BETWEEN 0.2 AND 5),
s AS (SELECT g.comparison_id, g.i, g.i2, count(*) FILTER (WHERE sqrt(power(a * p.ox - b * p.oy + c - p.nx, 2) + power(b * p.ox + a * p.oy + d - p.ny, 2)) <= 0.005 * sqrt(new_width * new_width + new_height * new_height)) AS inliers
  FROM g JOIN p USING (comparison_id) JOIN sheets s7 ON s7.comparison_id = g.comparison_id % 7 GROUP BY ALL)
SELECT comparison_id, i, i2, inliers FROM s QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY inliers DESC, i, i2) = 1""",
    "match_exact": f"WITH {_SIDES} SELECT comparison_id, old_id, new_id, round(distance, 6) AS distance FROM ({_T1})",
    "match_attribute": f"{_SQL_R}{_MATCH} SELECT comparison_id, old_id, new_id FROM t2",
    "match_greedy": f"""{_SQL_R}{_E}, {_greedy("t", '''SELECT a.comparison_id, a.entity_id AS old_id, b.entity_id AS new_id, sqrt((b.x0 - a.x0) * (b.x0 - a.x0) + (b.y0 - a.y0) * (b.y0 - a.y0)) AS distance
  FROM e a JOIN e b USING (comparison_id) WHERE a.kind = b.kind AND a.revision = 'old' AND b.revision = 'new'
  AND sqrt((b.x0 - a.x0) * (b.x0 - a.x0) + (b.y0 - a.y0) * (b.y0 - a.y0)) <= 60''')} SELECT comparison_id, old_id, new_id, round(distance, 6) AS distance FROM t""",
    "tier_counts": f"{_SQL_R}{_MATCH} SELECT comparison_id, tier, count(*) AS n FROM m GROUP BY ALL",
    "unmatched_entities": f"{_SQL_R}{_MATCH} SELECT * FROM alone",
    "label_alignment": f"""{_SQL_R}{_E}, {_greedy("t", '''SELECT a.comparison_id, a.entity_id AS old_id, CAST(1000000000 + r.ordinal AS VARCHAR) AS new_id, sqrt(power((r.x0 + r.x1) / 2 + 2 - (a.x0 + a.x1) / 2, 2) + power((r.y0 + r.y1) / 2 - (a.y0 + a.y1) / 2, 2)) AS distance
  FROM e a JOIN e r USING (comparison_id, kind) WHERE a.revision = 'old' AND r.revision = 'old'
  AND sqrt(power((r.x0 + r.x1) / 2 + 2 - (a.x0 + a.x1) / 2, 2) + power((r.y0 + r.y1) / 2 - (a.y0 + a.y1) / 2, 2)) <= 20.62''')}
SELECT comparison_id, old_id AS entity_id, CAST(new_id AS BIGINT) - 1000000000 AS record_id, round(distance, 6) AS distance FROM t""",
    "deltas": f"{_SQL_R}{_DELTA} SELECT comparison_id, delta_id, change_type, kinds, tier, old_id, new_id, x0, y0, x1, y1 FROM d",
    "delta_violations": "SELECT CAST(0 AS BIGINT) AS violations",
    "comparison_outcome": f"{_SQL_R}{_DELTA} SELECT s.comparison_id, count(d.delta_id) AS changes, CASE WHEN count(d.delta_id) > 0 THEN 'changes_found' ELSE 'no_changes' END AS outcome FROM sheets s LEFT JOIN d USING (comparison_id) GROUP BY ALL",
    "summary_lines": f"""{_SQL_R}{_DELTA} SELECT comparison_id, delta_id, CASE
  WHEN kind = 'dimension' AND change_type = 'added' THEN 'Dimension ' || {_Q.format("b_label")} || ' = ' || {_Q.format("b_dimension_value")} || ' added.'
  WHEN kind = 'dimension' AND change_type = 'removed' THEN 'Dimension ' || {_Q.format("a_label")} || ' = ' || {_Q.format("a_dimension_value")} || ' removed.'
  WHEN kind = 'dimension' AND contains(kinds, 'dimension_value') THEN 'Dimension ' || {_Q.format("b_label")} || ' changed from ' || {_Q.format("a_dimension_value")} || ' to ' || {_Q.format("b_dimension_value")} || '.'
  WHEN kind = 'dimension' THEN 'Dimension ' || {_Q.format("b_label")} || ' modified (' || {_KL} || ').'
  WHEN kind = 'text' AND contains(kinds, 'text') THEN 'Text changed from ' || {_Q.format("a_text_payload")} || ' to ' || {_Q.format("b_text_payload")} || '.'
  WHEN kind = 'text' AND change_type = 'modified' THEN 'Text ' || {_Q.format("b_text_payload")} || ' modified (' || {_KL} || ').'
  WHEN change_type = 'added' THEN 'New ' || kind || coalesce(' "' || b_text_payload || '"', ' entity') || ' added.'
  WHEN change_type = 'removed' THEN {_CAP.format("kind")} || coalesce(' "' || a_text_payload || '"', ' entity') || ' removed.'
  ELSE 'Entity modified (' || {_KL} || ').' END AS text, true AS values_grounded FROM d""",
    "change_report_counts": f"{_SQL_R}{_DELTA}, {_AREA} SELECT comparison_id, coalesce(total, 0) AS total, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified FROM sheets LEFT JOIN n USING (comparison_id)",
    "affected_area": f"{_SQL_R}{_DELTA}, {_AREA} SELECT * FROM area",
    "severity": f"{_SQL_R}{_DELTA}, {_AREA} SELECT comparison_id, changes, round(area, 4) AS area, round(pct, 6) AS affected_pct, severity FROM svl",
    "summary_table": f"""{_SQL_R}{_DELTA} SELECT comparison_id, position, delta_id, 'CH-' || CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0') ELSE CAST(position AS VARCHAR) END AS change,
  {_CAP.format("change_type")} || CASE WHEN kinds <> '' THEN ' (' || {_KL} || ')' ELSE '' END AS change_cell, kind AS entity,
  {_WHERE9.format(x="((x0 + x1) / 2)", y="((y0 + y1) / 2)", w="new_width", h="new_height")} AS location, {_OLD} AS old_value, {_NEW} AS new_value,
  CASE WHEN change_type = 'modified' AND kind = 'dimension' THEN printf('%+g cm', {_NUM})
    WHEN contains(kinds, 'moved') THEN printf('%.1f pt', sqrt(power((b_x0 + b_x1) / 2 - (a_x0 + a_x1) / 2, 2) + power((b_y0 + b_y1) / 2 - (a_y0 + a_y1) / 2, 2))) ELSE '' END AS delta, '' AS confidence
FROM p JOIN sheets USING (comparison_id)""",
    "top_changes": f"{_SQL_R}{_DELTA} SELECT comparison_id, n AS position, delta_id FROM (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY position) AS n FROM p WHERE change_type <> 'added') WHERE n <= 15",
    "recommendations": f"""{_SQL_R}{_DELTA}, {_AREA} SELECT comparison_id, coalesce(nullif(concat_ws(' ', CASE WHEN severity = 'High' THEN 'Immediate review: high severity revision.' END,
  CASE WHEN added > 0 THEN 'Verify ' || added || ' added entities.' END, CASE WHEN removed > 0 THEN 'Confirm ' || removed || ' removals.' END, CASE WHEN dims > 0 THEN 'Verify dimension readings.' END), ''),
  'Routine check: no critical changes.') AS recommendations FROM svl LEFT JOIN n USING (comparison_id)""",
    "markup_annotations": f"""{_SQL_R}{_DELTA} SELECT comparison_id, delta_id, CASE change_type WHEN 'added' THEN 'green' WHEN 'removed' THEN 'red' ELSE 'amber' END AS colour, x0 - 2 AS x0, y0 - 2 AS y0, x1 + 2 AS x1, y1 + 2 AS y1,
  (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM d""",
    "heat_circles": f"{_SQL_R}{_DELTA} SELECT comparison_id, delta_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(greatest(x1 - x0, y1 - y0) / 2, CAST(0.015 AS DOUBLE) * greatest(new_width, new_height)) AS radius FROM d JOIN sheets USING (comparison_id)",
    "change_values": f"{_SQL_R}{_DELTA} SELECT comparison_id, delta_id, CASE WHEN {_OLD} <> '' AND {_NEW} <> '' AND {_OLD} <> {_NEW} THEN {_OLD} || ' → ' || {_NEW} ELSE coalesce(nullif({_NEW}, ''), {_OLD}) END AS shown FROM d",
    "change_rollup": f"{_SQL_R}{_DELTA} SELECT change_type, kind, count(*) AS n FROM d GROUP BY ROLLUP (change_type, kind)",
    "compare_registered": f"{_SQL_R}{_DELTA}, {_AREA} SELECT comparison_id, CASE WHEN total > 0 THEN 'changes_found' ELSE 'no_changes' END AS outcome, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified FROM sheets LEFT JOIN n USING (comparison_id)",
    "ttl_sweep": f"WITH {_JOBS} SELECT job_id, state FROM gone",
    "ttl_keep": f"WITH {_JOBS} SELECT state, count(*) AS n FROM j WHERE job_id NOT IN (SELECT job_id FROM gone) GROUP BY state",
    "stage_timings": """SELECT job_id, round(sum(ms), 2) AS total_ms, count(*) AS stages FROM (SELECT user_id % 500 AS job_id, event_type, round(sum(round(value, 2)), 3) AS ms FROM events GROUP BY ALL) GROUP BY job_id""",
    "extra_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "extra_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "extra_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extra_asof": """SELECT p.event_id, v.event_id AS view_id FROM events p LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts < p.ts OR v.ts = p.ts AND v.event_id < p.event_id)
  ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true WHERE p.event_type = 'purchase'""",
}
_SCORE = """c AS (SELECT y.comparison_id, CAST(1000000000 + y.key_id AS VARCHAR) AS old_id, CAST(1000000000 + f.position AS VARCHAR) AS new_id, CAST(y.key_id AS DOUBLE) AS distance,
  least(y.x1, f.x1) - greatest(y.x0, f.x0) AS iw, least(y.y1, f.y1) - greatest(y.y0, f.y0) AS ih, (y.x1 - y.x0) * (y.y1 - y.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) AS area2
  FROM key y JOIN p f ON y.comparison_id = f.comparison_id AND y.change_type = f.change_type AND y.kind = f.kind
  AND coalesce(y.old_value = f.a_dimension_value, y.old_value IS NULL) AND coalesce(y.new_value = f.b_dimension_value, y.new_value IS NULL))"""
ORACLES["score_precision_recall"] = f"""{_SQL_R}{_DELTA}, key AS ({KEY_SQL}), {_SCORE},
{_greedy("g", "SELECT comparison_id, old_id, new_id, distance FROM c WHERE iw > 0 AND ih > 0 AND iw * ih / (area2 - iw * ih) >= 0.3")}
SELECT comparison_id, coalesce(g.n, 0) AS matched, coalesce(f.n, 0) AS found, coalesce(k.n, 0) AS expected, round(CASE WHEN f.n > 0 THEN coalesce(g.n, 0) / f.n ELSE 1 END, 6) AS precision,
  round(CASE WHEN k.n > 0 THEN coalesce(g.n, 0) / k.n ELSE 1 END, 6) AS recall FROM sheets LEFT JOIN (SELECT comparison_id, count(*) AS n FROM g GROUP BY 1) g USING (comparison_id)
LEFT JOIN (SELECT comparison_id, count(*) AS n FROM d GROUP BY 1) f USING (comparison_id) LEFT JOIN (SELECT comparison_id, count(*) AS n FROM key GROUP BY 1) k USING (comparison_id)"""

_HALVES = """WITH v AS (SELECT vec_id, vec_id // 60 AS comparison_id, CAST(embedding AS DOUBLE[])[1:32] AS a, CAST(embedding AS DOUBLE[])[33:64] AS b FROM embeddings),
p AS (SELECT x.comparison_id, x.vec_id = y.vec_id AS is_true, list_cosine_similarity(x.a, y.b) AS s FROM v x JOIN v y USING (comparison_id))"""
ORACLES["similarity_gap"] = f"""{_HALVES} SELECT comparison_id, round(min(s) FILTER (WHERE is_true), 6) AS min_true, round(max(s) FILTER (WHERE NOT is_true), 6) AS max_false FROM p GROUP BY comparison_id"""
ORACLES["cosine_matrix"] = """SELECT a.vec_id // 60 AS comparison_id, a.vec_id AS old_id, b.vec_id AS new_id,
  CASE WHEN a.label = b.label THEN round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) ELSE -1 END AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id // 60 = b.vec_id // 60 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"""
ORACLES["cosine_topk"] = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 5"""
ORACLES["graph_edges"] = f"""SELECT comparison_id, revision, source, target, edge_kind FROM ({ORACLES["knn_edges"]})
UNION SELECT comparison_id, revision, source, target, edge_kind FROM ({ORACLES["touch_edges"]})"""
ORACLES["summary_lookup"] = f"""SELECT t.comparison_id, t.position, t.change, l.text FROM ({ORACLES["summary_table"]}) t JOIN ({ORACLES["summary_lines"]}) l USING (comparison_id, delta_id)"""
ORACLES["first_changes"] = f"{_SQL_R}{_DELTA} SELECT comparison_id, position, delta_id FROM p WHERE position <= 15"

ORACLES["stage_signals"] = f"""{_SQL_R}{_DELTA} SELECT comparison_id, 'extracting' AS stage, 'entities_' || revision AS signal, count(*) AS value FROM e GROUP BY ALL
UNION ALL SELECT comparison_id, 'matching', tier, count(*) FROM m GROUP BY ALL UNION ALL SELECT comparison_id, 'matching', 'unmatched_' || revision, count(*) FROM alone GROUP BY ALL
UNION ALL SELECT comparison_id, 'diffing', change_type, count(*) FROM d GROUP BY ALL"""
