"""Operators 11 to 13 against brute force, SQL and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sheetdelta.llm import op11_suffix, op12_divergence, op13_resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, at int, first int, core string, whole int, ranges string, term string, n int, d int, vec string, rank int, score double, _able int, _row int, _range int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


BODY = words(300, 1)
ROWS = [
    (1, BODY, "en", "a"),
    (1, BODY, "en", "a"),
    (2, BODY[:700] + " other " + BODY[700:], "en", "b"),
    (3, words(20, 2) + "!" + BODY[100:499] + "!" + words(20, 3), "en", "a"),
    (4, words(20, 4) + "#" + BODY[100:500] + "#" + words(20, 5), "en", None),
    (5, words(20, 6) + "%" + BODY[100:501] + "%" + words(20, 7), None, "a"),
    (None, BODY[50:451], "de", "b"),
    (None, None, None, None),
    (7, None, "en", "c"),
    (8, "", "", ""),
    (9, " \n\t ", "fr", "a"),
    (10, "a" * 2_000, "fr", "a"),
    (11, "é😀" * 300 + "Ünï WORD word", "fr", "b"),
    (12, ("x" + words(70, 8)) * 3, "fr", "b"),
    (13, "A b-c_d e1f 2g\x00h " * 40, "en", "b"),
    (14, BODY[:400], "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, 2, 3, 4, "c", 5, "r", "t", 6, 7, "v", 8, 9.0, 10, 11, 12) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(texts):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[p : p + 400] for p in range(len(raw) - 399))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 399):
            if seen[raw[p : p + 400]] > 1:
                gone[p : p + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def repeats_of(spark, rows):
    df = rows if not isinstance(rows, list) else spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in op11_suffix.remove_repeats(df).collect()]


def test_bucket_pointers(spark, docs, nothing):
    want = brute_repeats([r[1] for r in ROWS])
    assert Counter(repeats_of(spark, docs)) == Counter(zip([r[0] for r in ROWS], want))
    found = dict(zip([r[0] for r in ROWS], want))
    assert found[3][1] == 0 and found[4][1] == 400 and found[5][1] == 401 and found[10][1] == 2_000
    assert repeats_of(spark, nothing) == []


def test_bucket_pointers_by_chance(spark):
    """Texts put together from few pieces: repeats of all lengths, overlaps, periods, and neighbours that differ."""
    r = random.Random(4)
    pieces = [words(r.randint(1, 60), 100 + k) for k in range(12)] + ["ab" * 90, "z" * 150, "é" * 100]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 9))) + str(k) for k in range(150)]
    assert dict(repeats_of(spark, texts)) == dict(enumerate(brute_repeats(texts)))


def test_bucket_pointers_long_texts(spark):
    """Texts of a million bytes: one letter, random letters, and a passage of the second in a third."""
    r = np.random.default_rng(1)
    noise = r.integers(97, 123, 1_000_000, np.uint8).tobytes().decode()
    texts = ["b" * 1_000_000, noise, "#" * 399 + noise[500_000:500_400] + "!" * 399, " " * 300_000]
    got = dict(repeats_of(spark, texts))
    assert [got[k][1:3] for k in range(4)] == [(1_000_000, 1), (400, 1), (400, 1), (300_000, 1)]


def test_bucket_pointers_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op11_suffix.op11_bucket_pointers(spark, data).collect()}
    assert got == dict(zip([d for d, _ in rows], brute_repeats([t for _, t in rows])))
    assert sum(x[1] for x in got.values()) > 10_000


def audit_sql(spark, rows, least=30):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(c.execute(op12_divergence.ORACLE_SQL.replace(">= 30", f">= {least}")).fetchall())


def test_divergence(spark, docs, nothing):
    for least in (1, 2, 30):
        got = sorted(tuple(r) for r in op12_divergence.audit(docs, least).collect())
        assert got == audit_sql(spark, [r[1:] for r in ROWS], least) and got
    assert op12_divergence.audit(nothing, 1).count() == 0


def test_divergence_ties_and_sources(spark):
    """Many terms with one vector, ties at the fiftieth rank, sources that miss terms, and non-ASCII order."""
    r = random.Random(3)
    vocabulary = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["é", "zé", "😀x", "ﬀ"]
    rows = []
    for k in range(120):
        source = r.choice("abcdefg")
        some = [w for i, w in enumerate(vocabulary) if (i + ord(source)) % 3 or i % 7 == 0]
        rows.append((" ".join(r.choices(some, k=40) + some[:20]), r.choice(["en", "de", None]), source))
    rows += [(None, "en", "silent"), ("rare", "xx", "a"), ("", "xx", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    for least in (5, 20):
        assert sorted(tuple(r) for r in op12_divergence.audit(df, least).collect()) == audit_sql(spark, rows, least)


def test_divergence_whole_numbers(spark):
    """Shares of counts whose products with SCALE pass 64 bits, and a text longer than a slice."""
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**14, 3 * 10**14, 7), (5, 10**15, 10**6), (10**12, 10**12, 1)]
    df = spark.createDataFrame(cases, "n long, a long, v long").select("n", "a", "v", op12_divergence.share(F.col("n"), F.col("a"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 5) // (r.a + 5 * r.v) for r in df.collect())
    text = "word other " * 200_000
    assert sum((Counter(x) for x in op12_divergence._pieces(text.encode())), Counter()) == {b"word": 200_000, b"other": 200_000}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target):
    found = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    out = []
    for d, w, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = k + 1
    return [tuple(x) for x in out]


def test_resampling(spark, docs, nothing):
    target = spark.createDataFrame([(words(50, 1),), (None,), ("é word",)], "text string")
    rows = [(r[0], r[1]) for r in ROWS]
    got = [tuple(r) for r in op13_resampling.resample(docs, target).collect()]
    assert Counter(got) == Counter(brute_resample(rows, [words(50, 1), None, "é word"]))
    assert Counter(tuple(r) for r in op13_resampling.resample(docs, nothing).collect()) == Counter(brute_resample(rows, []))
    assert op13_resampling.resample(nothing, target).count() == 0


def test_resampling_draw(spark, data):
    """The whole smallest table, with copies that tie and a long text; every drawn rank once."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(5000 + k, words(30, 9)) for k in range(60)] + [(6000, words(200_000, 10)), (6001, "x" * 1_000_000), (6002, "0 " * 300_000)]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in op13_resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect())
    assert got == sorted(brute_resample(rows, target))
    drawn = sorted(r[4] for r in got if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and drawn


def test_grams_of_many_words():
    """More words than fit three to a number, where places are sorted by columns."""
    grams = op13_resampling.Grams([b"b a", b"", b"a b c a b c"])
    assert [int((grams.buckets[k] >= 0).sum()) for k in range(3)] == [8, 6, 4]
    ids = np.array([[2, 1, 1, 2], [1, 0, 2, 0], [0, 0, 0, 0]])
    assert op13_resampling.Grams._order(ids, 1 << 40).tolist() == [1, 2, 3, 0] == op13_resampling.Grams._order(ids, 2).tolist()


def test_carried_checksums():
    for n in (0, 1, 2, 7, 300, 65_537):
        tail = bytes(range(256)) * (n // 256 + 1)
        joined = op13_resampling.carry(np.array([zlib.crc32(b"head")], np.uint32), n)[0] ^ zlib.crc32(tail[:n])
        assert joined == zlib.crc32(b"head" + tail[:n])


def test_divergence_flushes(monkeypatch):
    """Counts that a task gives away in parts add up to those that it holds to the end, a document's terms once in each."""
    import pyarrow as pa

    texts = [words(50, k) + " " + words(20, 1) for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 20), pa.array(["a", "b"] * 10)], ["text", "lang", "source"])

    def summed():
        out, parts = Counter(), 0
        for part in op12_divergence._count([batch]):
            parts += 1
            for r in part.to_pylist():
                out[r["source"], r["term"], "n"] += r["n"]
                out[r["source"], r["term"], "d"] += r["d"]
        return out, parts

    whole, one = summed()
    monkeypatch.setattr(op12_divergence, "HELD", 40)
    cut, many = summed()
    assert whole == cut and one == 1 and many > 5
