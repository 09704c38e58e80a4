"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes its set of distinct 5-word shingles; equal sets form a class with one representative.
2. Signatures of 24 bands x 4 rows give buckets; with a Jaccard similarity of 0.85 a pair shares none with probability 2e-8.
3. Every bucket has a hub, the member that shares most buckets with others.  Members are compared with their hubs; that
   joins most copies at a cost in proportion to the members, not to their pairs.
4. Only where a bucket still holds several components are members of different components compared, in blocks, so no link
   between components is lost and no pair within one is made; a pair is made in the first band that it shares only.
5. A comparison looks at the signatures in batches and stops as soon as the posterior probability of a similarity of at
   least 0.85 (uniform prior) falls under the miss probability.  Members of shared buckets have a long second signature
   of 1024 minima, one byte each, for this.  Survivors are confirmed on their full sets.
6. Star contractions turn links into components.

Defined results: null or wordless texts have an empty set and stay alone; repeated rows each get a row of the same
component; component_id is the smallest non-null doc_id, and rows without a doc_id are kept only if their class has none
(component_id null); an empty table gives an empty result; further columns are ignored.

The stage decides by doc_id and text together (a 128-bit digest), not by doc_id: one row of each component stays, the one with
the smallest doc_id (none last), so repeated rows, copies without a doc_id and different texts under one doc_id each get the right
verdict.  Of the rows of one doc_id and text that differ in further columns the one whose columns come first as JSON stays.

Joins with texts shuffle at every size, so that a plan over few documents is the plan over many.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import by_bytes
from .common import materialise, prepare, table
from .components import connected_components
from .shingles import MinHash, set_digest, shingle_sets

BANDS, ROWS, BATCH = 24, 4, 32
LONG, LONG_BATCH = 1024, 128
#: Percent of similarity from which documents are linked: by the operator's contract, and in the pipeline.
LINK, STAGE_LINK = 85, 80
MISS = 1e-7
BLOCK = 256
CHUNK = 1 << 21


def _bytes(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _sign(batches):
    hasher = MinHash(BANDS, ROWS)
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK):
            sets = shingle_sets(_bytes(part.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            for i, row in zip(full, hasher.signatures([sets[i] for i in full]) if full else []):
                sig[i], digest[i] = row.tobytes(), set_digest(sets[i])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("path"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "path", "n_shingles", "node", "sig"],
            )


def _band(batches):
    hasher = MinHash(BANDS, ROWS)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            keys = hasher.band_keys(sigs)
            node = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            number = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(number), node], ["band", "number", "node"])


def least_matches(threshold: float, batch: int, size: int, miss: float) -> list[int]:
    """For each prefix of whole batches, the least number of equal minima with which a pair goes on: the posterior of the
    similarity s after m of n equal is Beta(m + 1, n - m + 1), so P(s >= t) = sum over j <= m of C(n+1, j) t^j (1-t)^(n+1-j)."""
    out = []
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 2) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        out.append(m)
    return out


def _bounds(link: int) -> tuple[list[int], list[int]]:
    """Least matches on the banded and on the long signature.  The last byte of two different minima is equal once in 256 times."""
    share = link / 100
    return least_matches(share, BATCH, BANDS * ROWS, MISS), least_matches(share + (1 - share) / 256, LONG_BATCH, LONG, MISS)


def _posterior_pairs(a: np.ndarray, b: np.ndarray, batch: int, least: list[int]) -> np.ndarray:
    """Mask of the row pairs of two signature tables that survive every batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, enough in enumerate(least):
        cut = slice(k * batch, (k + 1) * batch)
        equal[alive] += (a[alive, cut] == b[alive, cut]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= enough]
    mask = np.zeros(len(a), bool)
    mask[alive] = True
    return mask


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _prune_rows(link: int):
    """Rows with sig_u and sig_v: keep those whose posterior allows a link."""
    least, _ = _bounds(link)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                mask = _posterior_pairs(_sigs(part.column("sig_u")), _sigs(part.column("sig_v")), BATCH, least)
                yield part.select(["u", "v"]).filter(pa.array(mask))

    return run


def _prune_blocks(link: int):
    """Rows sorted by (band, i, j): compare the residual members of a block with its other members, across components."""
    least, least_long = _bounds(link)

    def block(part: pa.Table):
        side = np.asarray(part.column("side").combine_chunks())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        sig = _sigs(part.column("sig").combine_chunks())
        long = np.frombuffer(b"".join(part.column("long").combine_chunks().to_pylist()), np.uint8).reshape(-1, LONG)
        band = int(part.column("number")[0].as_py())
        comp = np.array(part.column("comp").to_pylist(), object)
        node = part.column("node").combine_chunks()
        # Signatures of one batch decide most pairs: left rows one by one against all right rows of the block.
        us, vs = [], []
        for i in left.tolist():
            js = right[comp[right] != comp[i]]
            if len(js):
                ok = js[_posterior_pairs(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], BATCH, least)]
                shared = (sig[ok] == sig[i]).reshape(len(ok), BANDS, ROWS).all(2)
                ok = ok[shared.argmax(1) == band]
                ok = ok[_posterior_pairs(np.broadcast_to(long[i], (len(ok), LONG)), long[ok], LONG_BATCH, least_long)]
                us.append(np.full(len(ok), i))
                vs.append(ok)
        if not us:
            return None
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], ["u", "v"])

    def blocks(tbl: pa.Table, last: bool, ready: list):
        keys = np.stack([np.asarray(tbl.column(c).combine_chunks()).astype(np.int64) for c in ("band", "i", "j")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), tbl.num_rows]
        for a, b in zip(bounds, ends):
            if b == tbl.num_rows and not last:
                return tbl.slice(a)
            found = block(tbl.slice(a, b - a))
            if found is not None and found.num_rows:
                ready.append(found)
        return None

    def run(batches):
        rest, ready = None, []
        for batch in batches:
            if batch.num_rows:
                tbl = pa.Table.from_batches([batch])
                rest = blocks(pa.concat_tables([rest, tbl]) if rest is not None else tbl, False, ready)
                yield from ready
                ready.clear()
        if rest is not None and rest.num_rows:
            blocks(rest, True, ready)
            yield from ready

    return run


def _sets(batches):
    hasher = MinHash(1, LONG, seed=11)
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK):
            sets = [s for s in shingle_sets(_bytes(part.column("text"))) if len(s)]
            long = hasher.signatures(sets).astype(np.uint8) if sets else []
            columns = [pa.array(x, pa.binary()) for x in ([set_digest(s) for s in sets], [s.tobytes() for s in sets], [r.tobytes() for r in long])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "full", "long"])


def _confirm(link: int):
    def run(batches):
        for batch in batches:
            keep = []
            for u, v in zip(batch.column("full_u"), batch.column("full_v")):
                a, b = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= link * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs whose full sets are similar enough.  Sets travel only for rows in a pair that the posterior let through."""
    u = sets.select(F.col("node").alias("u"), F.col("full").alias("full_u"))
    v = sets.select(F.col("node").alias("v"), F.col("full").alias("full_v"))
    return pairs.join(u, "u").join(v, "v").mapInArrow(_confirm(link), "u binary, v binary")


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows = _components(docs.withColumn("path", F.xxhash64("doc_id", "text")), link)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _components(docs: DataFrame, link: int) -> DataFrame:
    """A row per row of ``docs`` (doc_id, path, text): doc_id, path, n_shingles, node (null without words), root (a node that names
    the component), component_id (its smallest doc_id)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.col("text").cast("string").alias("text"))
    kind = docs.schema["path"].dataType.simpleString()
    signed = materialise(docs.mapInArrow(_sign, f"doc_id long, path {kind}, n_shingles long, node binary, sig binary"), "signatures")
    classes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("path").alias("path"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")

    bands = classes.select("node", "sig").mapInArrow(_band, "band long, number int, node binary")
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(bands.join(sizes, "band"), "members")

    # The hub of a bucket: the member with most company over all its buckets, a property of the member alone.
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = materialise(members.join(company, "node"), "members")
    hubs = members.groupBy("band").agg(F.max(F.struct("company", "node"))["node"].alias("v"))
    pairs = members.join(hubs, "band").where(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v").distinct()
    sig = classes.select("node", "sig")
    signed_pairs = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u").join(
        sig.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v"
    )
    pairs = materialise(signed_pairs.mapInArrow(_prune_rows(link), "u binary, v binary"), "pairs")

    sets = _full_sets(docs, members.join(classes.select("node", "path"), "node"))
    links = materialise(_links(pairs, sets, link), "links")
    comps = connected_components(links)

    # Buckets that still hold several components.
    placed = members.select("band", "number", "node").join(comps, "node", "left").select("band", "number", "node", F.coalesce("root", "node").alias("comp"))
    placed = materialise(placed, "placed")
    share = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    open_bands = share.groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("main")).where("comps > 1")
    open_bands = open_bands.select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("nj"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("ni"), F.col("main.comp").alias("main"))
    inside = placed.join(open_bands, "band").join(sig, "node").join(sets.select("node", "long"), "node")
    block = F.xxhash64("node")
    left = inside.where(F.col("comp") != F.col("main")).select(
        "band", F.pmod(block, F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "number", "node", "comp", "sig", "long"
    )
    right = inside.select(
        "band", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(block, F.col("nj")).cast("int").alias("j"), F.lit(1).alias("side"), "number", "node", "comp", "sig", "long"
    )
    more = (
        left.union(right)
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
        .mapInArrow(_prune_blocks(link), "u binary, v binary")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    more = materialise(more, "pairs")
    if not more.isEmpty():
        comps = connected_components(links.union(_links(more, sets, link)))

    joined = comps.join(classes.select("node", "first_id"), "node")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.select("node", "first_id").join(comps, "node", "left").join(least, "root", "left")
    named = named.select(
        "node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return signed.select("doc_id", "path", "n_shingles", "node").join(named, "node", "left")


def _full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, full set, long signature) of the classes in ``members``, worked out again from the text of one row of each."""
    wanted = materialise(members.select("path").distinct(), "wanted")
    texts = docs.join(wanted.hint("merge"), "path", "left_semi").select("text")
    # A repeated row gives its class again.
    return materialise(texts.mapInArrow(_sets, "node binary, full binary, long binary").dropDuplicates(["node"]), "sets")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, the one with the smallest doc_id (none last); documents are linked from 80
    percent on, where a pair shares no band with probability 3e-6.  Rows without words all stay."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    named = F.md5(F.concat_ws("\u001f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").cast("string")))
    keyed = docs.withColumn(key, named)
    rows = _components(keyed.select("doc_id", F.col(key).alias("path"), "text"), STAGE_LINK).where(F.col("node").isNotNull())
    rows = materialise(rows.select("doc_id", "path", "root"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "path"))["path"]
    stays = rows.groupBy("root").agg(F.count("*").alias("n"), first.alias("stays")).where("n > 1")
    dropped = rows.join(stays, "root").where(F.col("path") != F.col("stays")).select(F.col("path").alias(key)).distinct()
    kept = keyed.join(materialise(dropped, "dropped").hint("merge"), key, "left_anti")
    # Rows that are repeated whole share a key; of those one stays.
    repeated = materialise(rows.groupBy(F.col("path").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    if not repeated.isEmpty():
        repeated = repeated.hint("merge")
        row = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
        one = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        kept = kept.join(repeated, key, "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every pair of documents that share a shingle; fit for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_have >= 85 * (na.n + nb.n - both_have)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc_id WHERE r.top < e.b),
c AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
