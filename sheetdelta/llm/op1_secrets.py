"""Secret scanning with an incremental blob ledger, in DataFrame and SQL functions only.

Every version of a text is content-addressed by its SHA-256.  The ledger holds one row per (blob, rule version) that has
been scanned, with its findings.  A run anti-joins the incoming blobs with the ledger, scans one copy of each unseen blob,
appends what it scanned to the ledger, and joins the ledger's findings back to every path (row) that holds the blob.

The ledger is a Parquet folder that runs share (``update``).  The query and the stage of the pipeline start one of their own and read
it again; ``history`` goes through two versions of a table and two rule versions with one ledger.  All joins are by content
address and shuffled, at every size; one content that holds a large share of the rows is split by adaptive skew joins.

Defined results: a null text counts as empty and has no findings; repeated rows each get a row, since findings are joined
by content; null ``doc_id`` passes through; an empty table gives an empty result; further columns of the input are ignored.

The query reports a private key by its first line, as the equal SQL does.  The stage masks the whole key: through the matching
END line or, where that is missing, the base64 text behind the first line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, spans_text, table

#: The kinds in the order of the contract, then those that this operator adds.
KINDS = ["assign", "access", "hex", "pem"]
BASE = 3
RUN = 512
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The same matches, found sooner: most places are passed over by their first letter.
_FIRST = "(?=[PpSsTtAa])"
ASSIGN_FAST = ASSIGN.replace("(?i)", f"(?i){_FIRST}", 1)
KEYWORD = f"(?i){_FIRST}(?:password|passwd|secret|token|api_?key)"
# A run that is too short holds no other match of its own kind, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)"
_BASE64 = r"[A-Za-z0-9+/=]"
#: From the first line of a key through its END line; else over the header fields, long base64 words and base64 lines behind it.
#: Line breaks may be escaped, as in JSON.  Possessive loops keep the search linear.
WHOLE_KEY = (
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:(?:(?!-----BEGIN |-----END )[\s\S])*+-----END \1PRIVATE KEY-----"
    rf"|(?:(?:\s|\\[rnt])++(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|{_BASE64}{{20,}}+)|{_BREAK}[\x20\t]*+{_BASE64}++(?=[\x20\t]*+(?:{_BREAK}|\z)))*+)"
)
RULE_VERSION, STAGE_VERSION = "rules-1", "rules-1-whole-keys"
FINDING = "array<struct<start:int,ord:int,end:int>>"


def no_finding() -> Column:
    return F.expr(f"cast(array() as {FINDING})")


def _spans(text: Column, pattern: str, ordinal: int, min_group: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, ord, end) in code points.

    Splitting by the pattern gives the pieces between the matches, so running lengths give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    searched = F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))
    # A lambda's argument is worked out once, an expression at each place that names it: so the text is searched once for each field.
    return F.flatten(F.transform(F.array(searched), lambda s: _placed(s["gaps"], s["hits"], pattern, ordinal, min_group)))


def _placed(gaps: Column, hits: Column, pattern: str, ordinal: int, min_group: tuple[int, int] | None) -> Column:
    # The patterns look at nothing behind a match, so a match by itself has the same groups.
    ok = F.transform(hits, lambda h: F.char_length(F.regexp_extract(h, pattern, min_group[0])) >= min_group[1] if min_group else F.lit(True))
    parts = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.char_length(g)).alias("gap"),
        F.transform(hits, lambda h: F.char_length(h)).alias("len"),
        ok.alias("ok"),
    )
    start = F.struct(F.lit(0).alias("at"), no_finding().alias("found"))

    def place(acc: Column, p: Column) -> Column:
        begin, end = acc["at"] + p["gap"], acc["at"] + p["gap"] + p["len"]
        one = F.array(F.struct(begin.alias("start"), F.lit(ordinal).alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["ok"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # Adding to an array copies it, so runs of RUN matches are placed by themselves and then moved by the lengths before them.
    def placed(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(parts) - 1, F.lit(0)) / RUN).cast("int")),
            lambda r: F.aggregate(F.slice(parts, r * RUN + 1, F.lit(RUN)), start, place),
        )

    before = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))

    def joined(runs: Column) -> Column:
        moved = F.aggregate(runs, before, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
        move = lambda r, by: F.transform(r["found"], lambda f: F.struct((f["start"] + by).alias("start"), f["ord"].alias("ord"), (f["end"] + by).alias("end")))
        return F.flatten(F.zip_with(runs, moved["all"], move))

    runs = F.flatten(F.transform(F.array(parts), placed))
    return F.flatten(F.transform(F.array(runs), joined))


def findings(text: Column, pem: str = PEM) -> Column:
    """All findings of one text.  A cheap search decides whether a kind's places need to be worked out at all."""
    return F.concat(
        F.when(text.rlike(KEYWORD), _spans(text, ASSIGN_FAST, 0, (2, 6))).otherwise(no_finding()),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(no_finding()),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(no_finding()),
        F.when(text.contains("PRIVATE KEY-----"), _spans(text, pem, 3)).otherwise(no_finding()),
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, key: list[str] | None = None, pem: str = PEM) -> DataFrame:
    """New ledger rows: blob, version and found of each blob of ``docs`` for which ``ledger`` (of the same columns) has no row of
    this version.  Only those blobs are scanned.  ``key`` names a row's path."""
    key = key or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    # One path stands for each blob; its hash picks it, so that texts move once and only those to be scanned.
    named = docs.select(F.sha2(text, 256).alias("blob"), F.xxhash64(*key).alias("path"), text.alias("body"))
    unseen = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    # Texts meet the unseen blobs by key; a sorted join may spill, whatever the number of blobs.
    blobs = named.join(unseen.hint("merge"), ["blob", "path"], "left_semi")
    # The generator keeps the filter on findings, and with it the scan, behind the join: blobs of the ledger are not scanned.
    fresh = blobs.select("blob", F.explode(F.array(findings(F.col("body"), pem))).alias("found")).where(F.size("found") > 0)
    # Repeated rows (same key, same text) pass the semi-join together; their findings are the same.
    fresh = materialise(fresh.dropDuplicates(["blob"]), "secret-findings")
    return unseen.select("blob").join(fresh, "blob", "left").select("blob", F.lit(version).alias("version"), F.coalesce("found", no_finding()).alias("found"))


def update(docs: DataFrame, path: str, version: str = RULE_VERSION, key: list[str] | None = None, pem: str = PEM) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen of ``docs``, append it, and return the ledger.  An empty path starts a ledger, which
    lies by version, so a run reads the rows of its own version only.  Two runs at once may append a blob twice; readers take it once."""
    spark = docs.sparkSession
    schema = f"blob string, version string, found {FINDING}"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("version").parquet(path)
    # The rows to append are worked out in full before the ledger that they depend on changes.
    new = materialise(scan(docs, spark.read.schema(schema).parquet(path), version, key, pem), "secret-ledger")
    new.write.mode("append").partitionBy("version").parquet(path)
    return spark.read.schema(schema).parquet(path)


def own_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def join_paths(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION, keep: list[str] | None = None) -> DataFrame:
    """(doc, found) for the rows of ``docs``: its columns (or those of ``keep``) as a struct, and the ledger's findings of its content."""
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), blob)
    hits = ledger.where((F.col("version") == version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    return rows.join(hits.hint("merge"), "blob", "left").select("doc", F.coalesce("found", no_finding()).alias("found"))


def digest(found: DataFrame, key: list[str]) -> DataFrame:
    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["ord"] == i)).cast("long")

    base = F.filter("found", lambda s: s["ord"] < BASE)
    return found.select(
        *[f"doc.{c}" for c in key],
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(BASE)],
        F.sha2(spans_text(base, KINDS), 256).alias("base_sha256"),
        spans_text(F.col("found"), KINDS).alias("spans"),
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of its findings replaced by ``mark``.

    Adding to a string copies it, so runs of RUN findings write a part of the text each, between the ends that they reach."""
    spans = F.sort_array(found)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda r: F.slice(spans, r * RUN + 1, F.lit(RUN)))
    reach = F.aggregate(
        F.transform(runs, lambda run: F.array_max(F.transform(run, lambda s: s["end"]))),
        F.array(F.lit(0)),
        lambda acc, end: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), end))),
    )

    def part(bounds: Column, run: Column) -> Column:
        begin = bounds["a"]
        region = F.substring(text, begin + 1, bounds["b"] - begin)
        return F.aggregate(
            run,
            F.struct(begin.alias("at"), F.lit("").alias("out"), region.alias("region")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(acc["region"], acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mark)))
                .otherwise(acc["out"])
                .alias("out"),
                acc["region"].alias("region"),
            ),
            lambda acc: acc["out"],
        )

    bounds = F.arrays_zip(F.slice(reach, F.lit(1), F.size(reach) - 1).alias("a"), F.slice(reach, F.lit(2), F.size(reach) - 1).alias("b"))
    whole = F.concat(F.array_join(F.zip_with(bounds, runs, part), ""), F.substring(text, F.element_at(reach, -1) + 1, F.char_length(text)))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their secrets masked, private keys whole; n_chars follows the text.  Every row stays."""
    ledger = update(docs, own_ledger(spark), STAGE_VERSION, pem=WHOLE_KEY)
    text, found = F.col("doc.text"), F.col("found")
    # The generator works the masked text out once.
    rows = join_paths(docs, ledger, STAGE_VERSION).select("doc", "found", F.explode(F.array(redact(text, found))).alias("masked"))
    n_chars = F.when(F.size(found) > 0, F.char_length("masked").cast("long")).otherwise(F.col("doc.n_chars"))
    new = {"text": F.col("masked"), "n_chars": n_chars}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(join_paths(docs, update(docs, own_ledger(spark)), keep=["doc_id"]), ["doc_id"])


#: The later version of a table in ``history``, in SQL that both engines read: every third document has a line more, every fifth
#: is gone, and the others are as they were.
LATER = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(coalesce(text, ''), '\n', 'token=abcdef', doc_id % 1000) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0"


def history(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(run, scanned, ledger_rows, findings, paths) of four runs with one ledger: a table, its later version, the first again, and the later one
    by other rules.  scanned: blobs scanned by the run; findings, paths: of the run's version of the table, by the ledger."""
    later = spark.sql(LATER.replace("FROM documents", "FROM {documents}"), documents=docs)
    path, out, before = own_ledger(spark), None, 0
    for run, (rows, version) in enumerate([(docs, "rules-1"), (later, "rules-1"), (docs, "rules-1"), (later, "rules-2")], 1):
        ledger = update(rows, path, version)
        now = ledger.count()
        hits = ledger.where((F.col("version") == version) & (F.size("found") > 0)).dropDuplicates(["blob"]).select("blob", F.size("found").alias("n"))
        named = rows.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).join(hits, "blob")
        one = named.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"), F.count("*").alias("paths"))
        one = one.select(F.lit(run).cast("long").alias("run"), F.lit(now - before).cast("long").alias("scanned"), F.lit(now).cast("long").alias("ledger_rows"), "findings", "paths")
        out, before = (materialise(one, "history") if out is None else out.union(materialise(one, "history"))), now
    return out


def secret_ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


_PLACES = """
  list_transform(range(1, len(hits) + 1), lambda k: struct_pack(
     s := list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda h: length(h))), 0),
     o := {o},
     e := list_sum(list_transform(gaps[1:k], lambda g: length(g))) + list_sum(list_transform(hits[1:k], lambda h: length(h))),
     ok := {ok}))
"""


def _duck_spans(pattern: str, o: int, ok: str) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT rid, unnest({_PLACES.format(o=o, ok=ok)}) AS p FROM (SELECT rid, string_split_regex(t, '{quoted}') AS gaps, "
        f"regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {2 if o == 0 else 0}) AS g2 FROM d WHERE regexp_matches(t, '{quoted}'))"
    )


_HITS = f"""
hit AS (
  SELECT rid, p.s AS s, p.o AS o, p.e AS e FROM (
    {_duck_spans(ASSIGN, 0, "length(g2[k]) >= 6")}
    UNION ALL {_duck_spans(ACCESS, 1, "true")}
    UNION ALL {_duck_spans(HEX, 2, "true")}
    UNION ALL {_duck_spans(PEM, 3, "true")}) WHERE p.ok)
"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {_HITS},
txt AS (
  SELECT rid, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
    coalesce(string_agg((['assign','access','hex','pem'])[o + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o) FILTER (WHERE o < 3), '') AS base,
    string_agg((['assign','access','hex','pem'])[o + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o) AS spans
  FROM hit GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN txt USING (rid)
"""

HISTORY_SQL = f"""
WITH d0 AS (SELECT 1 AS part, coalesce(text, '') AS t FROM documents UNION ALL SELECT 2, coalesce(text, '') FROM ({LATER})),
d AS (SELECT row_number() OVER () AS rid, part, t, sha256(t) AS blob FROM d0), {_HITS},
n AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
f AS (SELECT part, sum(n)::BIGINT AS findings, count(*) AS paths FROM n JOIN d USING (rid) GROUP BY part),
b AS (SELECT blob, bool_or(part = 1) AS old, bool_or(part = 2) AS new FROM d GROUP BY blob),
c AS (SELECT count(*) FILTER (WHERE old) AS a, count(*) FILTER (WHERE new AND NOT old) AS b, count(*) FILTER (WHERE new) AS c FROM b),
r AS (SELECT 1::BIGINT AS run, 1 AS part, a AS scanned, a AS ledger_rows FROM c UNION ALL SELECT 2, 2, b, a + b FROM c
  UNION ALL SELECT 3, 1, 0, a + b FROM c UNION ALL SELECT 4, 2, c, a + b + c FROM c)
SELECT run, scanned, ledger_rows, coalesce(findings, 0) AS findings, coalesce(paths, 0) AS paths FROM r LEFT JOIN f USING (part)
"""
