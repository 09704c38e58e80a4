"""Audit of how the sources of a language differ in their use of terms.

Terms are runs of ASCII letters (lowered) and non-ASCII characters.  A language keeps the terms in at least LEAST_DOCS of its documents.
Each source, and the language as a whole, gives a kept term the smoothed share p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
Pairs of sources are compared by the sum of |p - q| over all kept terms, and each source's terms by p - q against the language.

Count columns are deduplicated: the kept terms of a language with the same sparse vector of (source, count) are one column with a
multiplicity.  A pair of sources is evaluated once for each distinct vector that holds both.  Where a vector holds one of them only,
the other has the share of a count of 0, so sums over a source's counts, in order of p, serve all its partners: for a pair (g, h)

    sum |p - q| = V |zg - zh| + one(g, h) + one(h, g) + both(g, h)
    one(g, h)  = sum over vectors with g of  |pg - zh| - |zg - zh|
    both(g, h) = sum over vectors with both of  |pg - ph| - |pg - zh| - |zg - ph| + |zg - zh|

with z the share of a count of 0.  Terms are ranked by their vectors' values first: only vectors whose value is among a source's
best TOP, ties included, are opened to their terms again, and these are ranked.

Texts are counted per batch in tasks, so that frequent terms are few rows in the shuffle.  All arithmetic is in whole numbers.

Defined results: null text, lang and source are ''; a source without kept terms takes part with N = 0; a language without kept terms
has pairs with value 0 and no terms; repeated rows count each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, small_side, table

LEAST_DOCS, PRIOR, TOP = 30, 5, 50
#: SCALE in two factors, so that a division by steps stays within 64 bits for counts up to 2^63 / 32,000.
SCALE = (32_000, 31_250)
SLICE, HELD = 1 << 20, 300_000
_FOLD = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def _pieces(text: bytes):
    """Lists of the terms of a text, about SLICE bytes at a time."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _flush(pool: dict) -> pa.RecordBatch:
    columns: tuple[list, ...] = ([], [], [], [], [])
    for (lang, source), (counts, docs) in pool.items():
        n = len(counts)
        for column, values in zip(columns, ([lang] * n, [source] * n, counts.keys(), counts.values(), map(docs.__getitem__, counts))):
            column.extend(values)
    lang, source, term, n, d = columns
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"]
    )


def _count(batches):
    pool: dict = {}
    held = 0
    for batch in batches:
        for text, lang, source in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            counts, docs = pool.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(counts), set()
            for terms in _pieces(text.as_py()):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(counts) - before
            if held > HELD:
                yield _flush(pool)
                pool, held = {}, 0
    if pool:
        yield _flush(pool)


def share(count: Column, all_: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (all + PRIOR * kept)), exactly."""
    part = F.struct((SCALE[0] * (count + PRIOR)).alias("a"), (all_ + PRIOR * kept).alias("b"))
    return F.get(F.transform(F.array(part), lambda x: 1 + SCALE[1] * F.call_function("div", x.a, x.b) + F.call_function("div", SCALE[1] * (x.a % x.b), x.b)), 0)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, vec): the kept terms with their sorted (source, n) pairs, written."""
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return materialise(terms.where(F.col("d") >= least).drop("d"), "terms")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source)."""
    prepare(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms = kept_terms(docs, least)
    # A distinct vector has one total, so grouping by both is grouping by the vector.
    vectors = materialise(terms.groupBy("lang", "vec", "total").agg(F.count("*").alias("k")).withColumn("v", F.monotonically_increasing_id()), "vectors")
    langs = vectors.groupBy("lang").agg(F.sum("k").alias("kept"), F.sum(F.col("k") * F.col("total")).alias("all_lang"))
    cells = vectors.select("lang", "v", "k", "total", F.inline("vec"))
    used = cells.groupBy("lang", "source").agg(F.sum(F.col("k") * F.col("n")).alias("all"))
    groups = docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("all", "kept", "all_lang")])
    groups = materialise(groups.withColumn("z", F.when(F.col("kept") > 0, share(F.lit(0), F.col("all"), F.col("kept"))).otherwise(0)), "groups")
    of_group = cells.join(small_side(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all"), F.col("kept")))
    of_group = materialise(of_group.withColumn("q", share(F.col("total"), F.col("all_lang"), F.col("kept"))).select("lang", "v", "k", "source", "p", "z", "q"), "cells")
    return _pairs(groups, of_group).unionByName(_terms(terms, vectors, of_group, top))


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zh"))
    pairs = groups.select("lang", "source", "kept", F.col("z").alias("zg")).join(other, "lang").where("source <> item")
    # One holds a term, the other does not: the counts of a source and the shares that its partners give to none, in one order.
    counts = cells.groupBy("lang", "source", "p").agg(F.sum("k").alias("k"))
    points = counts.select("lang", "source", "p", "k", F.lit(None).cast("string").alias("item"), F.lit(0).alias("zg"))
    points = points.unionByName(pairs.select("lang", "source", F.col("zh").alias("p"), F.lit(0).cast("long").alias("k"), "item", "zg"))
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kp = F.col("k") * F.col("p")
    points = points.select("lang", "source", "item", "p", "zg", F.sum("k").over(below).alias("k0"), F.sum(kp).over(below).alias("kp0"), F.sum("k").over(group).alias("k1"), F.sum(kp).over(group).alias("kp1"))
    apart = F.col("p") * (2 * F.col("k0") - F.col("k1")) + F.col("kp1") - 2 * F.col("kp0") - F.col("k1") * F.abs(F.col("zg") - F.col("p"))
    one = points.where("item is not null").select("lang", "source", "item", apart.alias("value"))
    # Both hold it: once for each distinct vector.
    row = F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("row")

    def with_later(x, i):
        gap = lambda y: F.abs(x.p - y.p) - F.abs(x.p - y.z) - F.abs(x.z - y.p) + F.abs(x.z - y.z)
        return F.transform(F.slice("row", i + 2, F.size("row")), lambda y: F.struct(x.source.alias("a"), y.source.alias("b"), gap(y).alias("gap")))

    both = cells.groupBy("lang", "v", "k").agg(row).select("lang", "k", F.inline(F.flatten(F.transform("row", with_later))))
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * F.col("gap")).alias("value"))
    turned = lambda df, a, b: df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    none = pairs.select("lang", "source", "item", (F.col("kept") * F.abs(F.col("zg") - F.col("zh"))).alias("value"))
    parts = none.unionByName(one).unionByName(turned(one, "item", "source")).unionByName(turned(both, "a", "b")).unionByName(turned(both, "b", "a"))
    value = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group.orderBy(F.desc("value"), "item")).alias("rank"))


def _terms(terms: DataFrame, vectors: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    group = Window.partitionBy("lang", "source")
    value = cells.where("p > q").select("lang", "v", "source", (F.col("p") - F.col("q")).alias("value"))
    best = value.withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    named = terms.join(vectors.select("lang", "vec", "total", "v"), ["lang", "vec", "total"]).select("v", F.col("term").alias("item"))
    place = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    return best.join(named, "v").withColumn("rank", place).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS d FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(d) >= 30),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
used AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(u.n, 0) + 5 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (s.n + 5 * s.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM placed WHERE part = 'pair' OR rank <= 50
"""
