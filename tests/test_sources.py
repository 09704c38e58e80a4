"""Generated pairs, files and streams."""

import json
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheetdelta.operators.jobs import follows
from sheetdelta.plans import fixtures, synth
from sheetdelta.plans.compare import compare
from sheetdelta.schema import STATES, TERMINAL
from sheetdelta.sources import pdf, records
from sheetdelta.streaming import live


def pdf_bytes(content: bytes, flate=False, extra=b""):
    body = zlib.compress(content) if flate else content
    head = b"<< /Length %d%s >>" % (len(body), b" /Filter /FlateDecode" if flate else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 842 595] >> endobj\n2 0 obj " + head + b" stream\n" + body + b"\nendstream endobj\n" + extra + b"trailer << >>\n%%EOF"


CONTENT = b"1 0 0 RG 2 w 60 55 720 480 re S 0.8 w 100 100 m 150 120 l S BT /F1 10 Tf 100 300 Td (W = 40 cm) Tj ET BT /F1 12 Tf 200 300 Td (HALL) Tj ET q Q"


def test_pdf(spark, tmp_path):
    files = {"a.pdf": pdf_bytes(CONTENT), "b.pdf": pdf_bytes(CONTENT, True), "raster.pdf": pdf_bytes(b"q Q"), "locked.pdf": pdf_bytes(CONTENT, extra=b"/Encrypt 5 0 R\n"), "cut.pdf": b"%PDF-1.4 nothing", "odd.pdf": b"hello"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = pdf.checked(pdf.provider("pdf")(spark, str(tmp_path)))
    reasons = {r.path.rpartition("/")[2]: r.reason for r in found.collect()}
    assert reasons == {"a.pdf": None, "b.pdf": None, "raster.pdf": "raster_or_empty", "locked.pdf": "unreadable", "cut.pdf": "unreadable", "odd.pdf": "unsupported_format"}
    good = found.where("reason is null").withColumns({"comparison_id": F.lit(1), "revision": F.when(F.col("path").endswith("a.pdf"), "old").otherwise("new")})
    e = pdf.to_entities(good).orderBy("revision", "ordinal").collect()
    assert [x.kind for x in e] == ["linework", "linework", "dimension", "text"] * 2
    assert (e[0].x0, e[0].y0, e[0].x1, e[0].y1, e[0].stroke, e[0].width) == (60.0, 60.0, 780.0, 540.0, "#ff0000", 2.0)
    assert (e[2].label, e[2].dimension_value, e[2].anchor_y) == ("W", "40 cm", 295.0)
    with pytest.raises(ValueError):
        pdf.provider("dxf")


def test_pdf_graphics_state():
    """Transforms with save and restore, closed paths, short curves, turned rectangles, colours, arrays of strings; too few operands."""
    content = (
        b"q 2 0 0 2 10 20 cm 1 w 0 0 m 5 0 l 5 5 l h S 0 1 0 rg 1 1 3 2 re f Q 1 0 0 RG 0 0 m 1 1 2 2 v 3 3 4 4 y S "
        b"q 0 1 -1 0 0 0 cm 1 2 3 4 re S Q 0.5 g 0 0 m 9 0 l b 1 2 re S m BT /F 10 Tf 2 0 0 2 50 60 Tm [(W ) -20 (= ) <34302063>(m)] TJ 0 -10 Td (A\\(\\051) Tj ET"
    )
    items = pdf.scan(pdf_bytes(content))["items"]
    shapes = [([(o["op"], [(p["x"], 595 - p["y"]) for p in o["points"]]) for o in i["ops"]], i["stroke"], i["fill"], i["width"]) for i in items if i["text"] is None]
    black, red, green, grey = [0.0] * 3, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.5] * 3
    assert shapes == [
        ([("l", [(10, 20), (20, 20)]), ("l", [(20, 20), (20, 30)]), ("l", [(20, 30), (10, 20)])], black, None, 2.0),
        ([("re", [(12, 26), (18, 22)])], None, green, None),
        ([("c", [(0, 0), (0, 0), (1, 1), (2, 2)]), ("c", [(2, 2), (3, 3), (4, 4), (4, 4)])], red, None, 1.0),
        ([("qu", [(-6, 1), (-6, 4), (-2, 1), (-2, 4)])], red, None, 1.0),
        ([("l", [(0, 0), (9, 0)]), ("l", [(9, 0), (0, 0)])], red, grey, 1.0),
    ]
    assert [(i["text"], i["x"], 595 - i["y"], i["size"]) for i in items if i["text"]] == [("W = 40 cm", 50, 60, 20), ("A()", 50, 40, 20)]
    assert pdf.scan(pdf_bytes(b"1 2 re"))["items"] == [] and pdf.scan(pdf_bytes(CONTENT, True)[:150] + b"%%EOF")["items"] == []


def test_pdf_pages_and_object_streams():
    """The page asked for, by the page tree, also where its object lies in an object stream."""
    first, second = b"0 0 m 1 1 l S", zlib.compress(b"5 5 m 6 6 l S 7 7 m 8 8 l S")
    packed = b"<< /Type /Page /Contents [6 0 R] /MediaBox [0 0 200 100] >>"
    stream = zlib.compress(b"4 0 " + packed)
    data = (
        b"%PDF-1.5\n1 0 obj << /Type /Pages /Kids [4 0 R 3 0 R] >> endobj\n3 0 obj << /Type /Page /Contents 5 0 R /MediaBox [0 0 842 595] >> endobj\n"
        b"5 0 obj << /Length 13 >> stream\n" + first + b"\nendstream endobj\n6 0 obj << /Filter /FlateDecode >> stream\n" + second + b"\nendstream endobj\n"
        b"7 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj\n%%EOF"
    )
    found = [pdf.scan(data, k) for k in range(3)]
    assert [(f["pages"], len(f["items"])) for f in found] == [(2, 2), (2, 1), (2, 0)] and [f["page_width"] for f in found[:2]] == [200.0, 842.0]


def kinds(c):
    return Counter((d.change_type, ",".join(d.kinds)) for d in c.deltas.collect())


def test_mutations(spark):
    """A shift past the tier of in-place changes is one entity gone and one come, as no learned tier is given."""
    cases = {
        "dim-change": {("modified", "text,dimension_value"): 1}, "add": {("added", ""): 1}, "remove": {("removed", ""): 1}, "move": {("added", ""): 1, ("removed", ""): 1},
        "text-edit": {("modified", "text"): 1}, "style": {("modified", "style"): 1}, "twin": {("added", ""): 1, ("removed", ""): 1}, "dim-grow": {("modified", "text,dimension_value"): 1},
        "dim-change-move": {("modified", "moved,text,dimension_value"): 1},
    }
    rows = None
    for i, m in enumerate(cases):
        p = synth.pair(spark, [m], comparison_id=i)
        rows = p if rows is None else rows.union(p)
    c = compare(rows, synth.sheets(spark, list(range(len(cases)))), registered=True)
    got = {}
    for d in c.deltas.collect():
        got.setdefault(d.comparison_id, Counter())[d.change_type, ",".join(d.kinds)] += 1
    assert {m: dict(got[i]) for i, m in enumerate(cases)} == cases


def test_export_changes_nothing(spark):
    c = compare(synth.pair(spark, [], 12.0, -8.0).union(synth.pair(spark, [], 3.0, 2.0, 1.02, comparison_id=1)), synth.sheets(spark, [0, 1]))
    assert {r.outcome for r in c.outcomes.collect()} == {"no_changes"}
    with pytest.raises(Exception, match="leaves the page"):
        synth.exported(synth.plan(spark), 500.0).count()


def test_move_is_found_by_similarity(spark):
    e = synth.pair(spark, ["move"])
    named = compare(e, synth.sheets(spark, [0]), registered=True).entities
    # The shape's size as its vector: the moved piece of furniture is its own best match.
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.sqrt(w * w + h * h)
    v = named.select("comparison_id", "revision", "entity_id", F.array(w / n, h / n).alias("vector"))
    assert kinds(compare(e, synth.sheets(spark, [0]), v, registered=True)) == {("modified", "moved"): 1}
    far = synth.pair(spark, ["move"], distance=560.0)
    w2 = compare(far, synth.sheets(spark, [0]), registered=True).entities
    v2 = w2.select("comparison_id", "revision", "entity_id", F.array(w / n, h / n).alias("vector"))
    assert kinds(compare(far, synth.sheets(spark, [0]), v2, registered=True)) == {("added", ""): 1, ("removed", ""): 1}


def test_dense_sheet(spark):
    old = synth.dense(spark, 2000)
    new = old.where("ordinal % 100 <> 0").withColumn("revision", F.lit("new"))
    c = compare(old.union(new), synth.sheets(spark, [0]), registered=True)
    assert kinds(c)["removed", ""] == 20


def test_json_files(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps([{"uid": "s1", "kind": "text", "semantic": "note", "bbox": [1, 2, 3, 4], "text": "A"}]))
    (r,) = records.read_records(spark, str(tmp_path / "v1.json")).collect()
    assert r.uid == "s1" and r.bbox == [1.0, 2.0, 3.0, 4.0]
    for name, text in {"j1": '{"id": "j1", "state": "done"}', "j2": "not json"}.items():
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "job.json").write_text(text)
    assert {r.job_id: r.state for r in records.read_jobs(spark, str(tmp_path / "jobs")).collect()} == {"j1": "done", "j2": None}
    records.write_by_comparison(spark.createDataFrame([(1, "a"), (2, "b")], "comparison_id int, report string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def run_all(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_event_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = run_all(live.tumbling(stream), "tumbling", "complete").agg(F.sum("n")).first()[0]
    assert got == events.count()
    assert run_all(live.sliding(stream), "sliding", "complete").agg(F.sum("n")).first()[0] == 4 * events.count()
    assert run_all(live.sessions(stream), "sessions", "complete").agg(F.sum("n")).first()[0] == events.count()


def test_comparison_stream(spark, data, tmp_path):
    e = fixtures.entities(spark, data).where("comparison_id < 2")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    q = live.compare_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), fixtures.sheets(spark), lambda d, n: found.append(d.count()), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert q.exception() is None and len(found) == 1 and found[0] > 0


def test_job_states(spark, tmp_path):
    rows = [(1, "pending", "2024-01-01 00:00:00"), (1, "done", "2024-01-01 00:10:00"), (1, "failed", "2024-01-01 00:20:00"), (2, "matching", "2024-01-01 00:00:00")]
    later = [(3, "pending", "2024-01-05 00:00:00")]
    schema = "job_id long, state string, ts string"
    for i, part in enumerate((rows, later, [(4, "pending", "2024-01-06 00:00:00")])):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"u{i}"))
    import os
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(3):
        for p in (tmp_path / f"u{i}").glob("*.parquet"):
            shutil.copy(p, tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema("job_id long, state string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {(r.job_id, r.state, r.expired) for r in run_all(live.job_states(stream), "job_states").collect()}
    assert {(1, "done", False), (2, "matching", False), (1, "done", True), (3, "pending", False)} <= out
    assert (2, "matching", True) not in out


def test_job_moves(spark, tmp_path):
    import os
    import shutil

    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    day = "2024-01-0"
    batches = [
        [(1, s, f"{day}1 00:{i:02d}:00") for i, s in enumerate(STATES[:9])]
        + [(1, "failed", f"{day}1 00:30:00"), (2, "pending", f"{day}1 00:00:00"), (2, "extracting", f"{day}1 00:01:00"), (2, "extracting", f"{day}1 00:02:00")]
        + [(3, "matching", f"{day}1 00:00:00"), (4, "pending", f"{day}1 00:00:00"), (4, "declined", f"{day}1 00:01:00"), (4, None, f"{day}1 00:02:00")],
        [(2, "rejected", f"{day}1 01:00:00"), (2, "classifying", f"{day}1 01:01:00"), (4, "failed", f"{day}1 01:00:00"), (5, "pending", f"{day}5 00:00:00")],
        # Behind the watermark: dropped.
        [(5, "failed", f"{day}1 00:00:00"), (5, "extracting", f"{day}5 00:01:00"), (7, "pending", f"{day}6 00:00:00")],
        [(6, "pending", f"{day}7 00:00:00")],
    ]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "job_id long, state string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"u{i}"))
        (file,) = (tmp_path / f"u{i}").glob("*.parquet")
        shutil.copy(file, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    stream = session.readStream.schema("job_id long, state string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_all(live.job_moves(stream), "job_moves").collect()
    moved = [(r.job_id, r.before, r.state) for r in sorted(out, key=lambda r: (r.job_id, r.ts)) if r.outcome == "moved"]
    assert [x for x in moved if x[0] == 1][:9] == [(1, b, s) for b, s in zip([None, *STATES[:8]], STATES[:9])]
    assert [x[2] for x in moved if x[0] == 2] == ["pending", "extracting", "rejected"]
    assert {(r.job_id, r.before, r.state) for r in out if r.outcome == "illegal"} == {
        (1, "done", "failed"), (2, "rejected", "classifying"), (3, None, "matching"), (4, "pending", "declined"), (4, "pending", None)
    }
    assert {(r.job_id, r.before) for r in out if r.outcome == "expired"} == {(1, "done"), (2, "rejected"), (4, "failed")}
    assert [x[2] for x in moved if x[0] == 5] == ["pending", "extracting"]


def test_states_that_follow():
    assert [s for s in STATES if follows("extracting", s)] == ["classifying", "failed", "rejected"]
    assert [s for s in STATES if follows("registering", s)] == ["matching", "failed", "declined"]
    assert [s for s in STATES if follows(None, s)] == ["pending"] and not any(follows(t, s) for t in TERMINAL for s in STATES)
    assert not follows("pending", None) and not follows("pending", "nonsense")
