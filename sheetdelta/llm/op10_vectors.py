"""Approximate nearest neighbours with balanced posting lists.

Largest inner product becomes nearest distance by one more component, sqrt(M^2 - |x|^2) for a row and 0 for a query (M: the
largest norm).  Centroids are fitted on a bounded sample; lists of the sample that grow past twice the mean are split, so lists
are balanced.  A row goes to its nearest centroid and, if it lies near a boundary, to those whose distance is within a ratio
(BOUNDARY) of the nearest one, REPLICAS in all at most.  Centroids are searched through an in-memory neighbour graph.

A query takes every list whose centroid distance is within a ratio of its best.  That ratio is the least one by which the
sample's own rows find a share of TARGET of their best neighbours in the sample; so clustered vectors are searched in few lists, and
vectors without structure in many.  There is no cap on lists, and a query whose lists hold fewer than K rows besides its own takes the
next ones until they hold as many, all lists at last.

Lists that lie together form GROUPS groups (more where a group would have over 62 lists).  A row or a query goes once to each
group, with a bit for each of its lists there, so a query's copies and what they return do not grow with the table until a group
has over BLOCK rows.  Groups are dealt to blocks of bounded size; a block scores each query against the rows that share a list with it, with the
original vectors in double precision, and the best K of each block meet in a final choice.

Places are worked out after scaling by a power of two that brings the median row's largest component to about 1.  Rows whose largest
component is over BIG times that are in every list, as their products outweigh all others; queries that far from it, up or down, are
placed by their direction.  Scores are of the original vectors; a product that is no number (infinities that cancel) ranks last.

Every row is indexed; only the fit looks at a sample (about SAMPLE rows, those with the smallest hashes).  Measured recall on the
test tables is in the README.

Defined results: rows whose vector is null, empty, zero, or holds null or non-finite components, or whose dimension is not the
most frequent one, take no part; repeated rows are candidates each, and queries each; ties go to the smaller vec_id; with fewer
than K candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, table

K = 20
SAMPLE, MAX_LISTS, LIST_ROWS = 20_000, 4_096, 128
REPLICAS, BOUNDARY = 4, 1.04
TARGET, TRIALS = 0.96, 256
#: How far a vector's largest component may lie from the median row's, as a factor, before its squares are not to be trusted.
BIG = 1e100
GROUPS, BLOCK = 16, 32_768


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def fit(x: np.ndarray, lists: int, seed: int = 5, rounds: int = 6) -> np.ndarray:
    """Centroids of balanced lists over a sample: k-means, then every list over twice the mean is split in two until none is."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    for _ in range(6):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        large = np.flatnonzero(size > 2 * max(1, len(x) / lists))
        if not len(large) or len(centres) >= 2 * MAX_LISTS:
            break
        more = []
        for k in large:
            own = x[near == k]
            a, b = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(4):
                left = ((own - a) ** 2).sum(1) <= ((own - b) ** 2).sum(1)
                if left.all() or not left.any():
                    break
                a, b = own[left].mean(0), own[~left].mean(0)
            centres[k] = a
            more.append(b)
        centres = np.concatenate([centres, more])
    return centres


def group_size(lists: int) -> int:
    return min(62, -(-lists // GROUPS))


def near_order(centres: np.ndarray) -> np.ndarray:
    """Places of the centroids such that neighbours in order lie together: halves by the widest component, again and again."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(centres))]
    while todo:
        own = todo.pop()
        if len(own) <= group_size(len(centres)):
            out.append(own)
            continue
        c = centres[own]
        own = own[np.argsort(c[:, c.var(0).argmax()], kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out)


def _replicas(d: np.ndarray) -> np.ndarray:
    """Which of the nearest lists, in order of squared distance, hold a row."""
    ok = d <= d[..., :1] * BOUNDARY**2 + 1e-12
    ok[..., REPLICAS:] = False
    return ok


def fit_ratio(x: np.ndarray, centres: np.ndarray) -> float:
    """The least ratio of list distances at which TRIALS rows of the sample ``x`` find TARGET of their K best sample rows."""
    ask = np.unique(np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(np.int64))
    score = x[ask, :-1] @ x[:, :-1].T
    score[np.arange(len(ask)), ask] = -np.inf
    k = min(K, len(x) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    q = x[ask].copy()
    q[:, -1] = 0
    far = _distances(q, centres)
    far /= np.maximum(far.min(1, keepdims=True), 1e-30)
    need = np.empty(best.shape)
    for i, rows in enumerate(best):
        d = _distances(x[rows], centres)
        order = np.argsort(d, axis=1, kind="stable")[:, : REPLICAS + 1]
        held = _replicas(np.take_along_axis(d, order, 1))
        need[i] = np.where(held, far[i][order], np.inf).min(1)
    return float(np.sqrt(np.quantile(need, TARGET, method="higher"))) * (1 + 1e-9)


class Graph:
    """Neighbour graph of the centroids with best-first search from the nearest of some entries."""

    def __init__(self, centres: np.ndarray, degree: int = 24):
        self.centres = centres
        n = len(centres)
        degree = min(degree, n - 1)
        blocks = [np.argsort(_distances(centres[i : i + 1024], centres), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 1024)]
        links = np.concatenate(blocks) if degree > 0 else np.zeros((n, 0), np.int64)
        back: list[set[int]] = [set(row) for row in links.tolist()]
        for i, row in enumerate(links.tolist()):
            for j in row[: degree // 2]:
                back[j].add(i)
        self.near = [np.array(sorted(b), np.int64) for b in back]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 2 * int(n**0.5) + 1)).astype(np.int64))

    def starts(self, q: np.ndarray) -> np.ndarray:
        """For each row of ``q`` the 4 nearest entries."""
        d = _distances(q, self.centres[self.entries])
        return self.entries[np.argsort(d, axis=1, kind="stable")[:, :4]]

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first: the nearest ``beam`` at least, and all within ``ratio`` of the best."""
        seen = np.zeros(len(self.centres), bool)
        seen[start] = True
        ids, d, done = start, ((self.centres[start] - q) ** 2).sum(1), np.zeros(len(start), bool)
        while True:
            order = np.argsort(d, kind="stable")
            ids, d, done = ids[order], d[order], done[order]
            reach = max(min(beam, len(ids)), int(np.searchsorted(d, d[0] * ratio**2 + 1e-12, "right")))
            todo = np.flatnonzero(~done[:reach])[:16]
            if not len(todo):
                return ids, d
            done[todo] = True
            new = np.unique(np.concatenate([self.near[i] for i in ids[todo]]))
            new = new[~seen[new]]
            seen[new] = True
            ids = np.concatenate([ids, new])
            d = np.concatenate([d, ((self.centres[new] - q) ** 2).sum(1)])
            done = np.concatenate([done, np.zeros(len(new), bool)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths; a slice's own values only."""
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _emit(batch: pa.RecordBatch, places: list[np.ndarray], firsts: list[int], size: int) -> pa.RecordBatch:
    """A row per (row, group) with a bit for each list; ``places``: the lists of each row; ``firsts``: its own list, named once."""
    row, group, bits, first = [], [], [], []
    for i, (p, own) in enumerate(zip(places, firsts)):
        groups, of = np.unique(p // size, return_inverse=True)
        mask = np.zeros(len(groups), np.int64)
        np.bitwise_or.at(mask, of, np.left_shift(1, p % size))
        row += [i] * len(groups)
        group += groups.tolist()
        bits += mask.tolist()
        first += [own if g == own // size else None for g in groups.tolist()]
    at = pa.array(row, pa.int64())
    columns = [pa.array(group, pa.int32()), pa.array(bits, pa.int64()), pa.array(first, pa.int32()), *[batch.column(c).take(at) for c in ("row", "vec_id", "v")]]
    return pa.RecordBatch.from_arrays(columns, ["grp", "bits", "own_list", "row", "vec_id", "v"])


def _assign(centres: np.ndarray, top: float, scale: float = 1.0):
    """Rows to lists: the nearest centroid and those within the boundary ratio, by the graph; outsized rows to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(centres)
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore"):
                    x = _matrix(batch.column("v")) * scale
                outsized = np.abs(x).max(1) > BIG
                x[outsized] = 0
                full = np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]], 1)
                places = []
                for q, start, large in zip(full, graph.starts(full), outsized.tolist()):
                    c, d = graph.search(q, start, 4 * REPLICAS, BOUNDARY)
                    places.append(np.arange(len(centres)) if large else c[_replicas(d)])
                yield _emit(batch, places, [int(p[0]) for p in places], group_size(len(centres)))

    return run


def _probe(centres: np.ndarray, ratio: float, held: np.ndarray, top: float = 1.0, scale: float = 1.0):
    """Queries to lists: all within the ratio, and more until the lists' own rows are K besides those of the query's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(centres)
        for batch in batches:
            if batch.num_rows:
                raw = _matrix(batch.column("v"))
                most = np.abs(raw).max(1, keepdims=True)
                with np.errstate(over="ignore"):
                    x = raw * scale
                odd = ((np.abs(x).max(1) > BIG) | (np.abs(x).max(1) < 1 / BIG)).ravel()
                way = raw[odd] / most[odd]
                x[odd] = way / np.sqrt((way * way).sum(1, keepdims=True)) * top
                full = np.concatenate([x, np.zeros((len(x), 1))], 1)
                places = []
                for q, start, same in zip(full, graph.starts(full), batch.column("same").to_pylist()):
                    c, d = graph.search(q, start, 16, ratio)
                    n = int(np.searchsorted(d, d[0] * ratio**2 + 1e-12, "right"))
                    if held[c[:n]].sum() < K + same:
                        c = np.argsort(_distances(q[None], centres)[0], kind="stable")
                        n = max(n, int(np.searchsorted(np.cumsum(held[c]), K + same)) + 1)
                    places.append(c[:n])
                yield _emit(batch, places, [-1] * len(places), group_size(len(centres)))

    return run


def _score(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best K rows of one block for each of its queries, among those that share a list with it."""
    schema = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
    ids, rows, bits = (np.asarray(right.column(c)) for c in ("vec_id", "row", "bits"))
    q_ids, q_rows, q_bits = (np.asarray(left.column(c)) for c in ("vec_id", "row", "bits"))
    slack = 1e-12 * np.abs(x).max(1) * np.sqrt(x.shape[1])
    largest = np.finfo(float).max
    out = []
    for at in range(0, len(q), 128):
        part = slice(at, at + 128)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.nan_to_num(q[part] @ x.T, nan=-largest, posinf=largest, neginf=-largest)
            wide = np.minimum(slack[None, :] * np.abs(q[part]).sum(1, keepdims=True), largest)
        rough[((q_bits[part, None] & bits[None, :]) == 0) | (q_ids[part, None] == ids[None, :])] = -np.inf
        k = min(K, len(x))
        # The product of matrices may round otherwise, so scores near the edge are worked out anew, one way for all blocks.
        least = np.partition(np.where(rough > -np.inf, np.maximum(rough - wide, -largest), rough), len(x) - k, axis=1)[:, len(x) - k]
        for i, (r, edge, by) in enumerate(zip(rough, least, wide), at):
            near = np.flatnonzero((np.minimum(r + by, largest) >= edge) & (r > -np.inf))
            with np.errstate(over="ignore", invalid="ignore"):
                s = (x[near] * q[i]).sum(1)
            best = np.lexsort((rows[near], ids[near], np.where(np.isnan(s), np.inf, -s)))[:K]
            near = near[best]
            out.append((np.full(len(near), q_rows[i]), np.full(len(near), q_ids[i]), rows[near], ids[near], s[best]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)


def index(rows: DataFrame, n: int, top: float, scale: float = 1.0) -> tuple[np.ndarray, float, DataFrame]:
    """(centroids, query ratio, posted rows) of ``rows`` (row, vec_id, v): ``n`` of them, with ``top`` the largest norm of those that are
    not outsized, after scaling."""
    share = min(1.0, SAMPLE / max(1, n))
    low, high = -(1 << 63), (1 << 63) - 1
    usual = rows.where(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))) * scale <= BIG)
    picked = usual if share == 1.0 else usual.where(F.xxhash64("vec_id", "row") <= F.lit(int(low + share * (high - low))))
    sample = np.array([r.v for r in picked.select("v").toLocalIterator()], np.float64)
    if not len(sample):
        sample = np.array([r.v for r in usual.select("v").limit(K).collect()], np.float64)
    sample = sample * scale
    sample = np.concatenate([sample, np.sqrt(np.maximum(top * top - (sample * sample).sum(1), 0))[:, None]], 1)
    centres = fit(sample, min(MAX_LISTS, max(1, n // LIST_ROWS)))
    centres = centres[near_order(centres)]
    kind = rows.schema["v"].dataType.simpleString()
    posted = rows.select("row", "vec_id", "v").mapInArrow(_assign(centres, top, scale), f"grp int, bits long, own_list int, row long, vec_id long, v {kind}")
    return centres, fit_ratio(sample, centres), materialise(posted, "lists")


def search(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``vectors`` and ``queries``: vec_id, embedding.  (query_id, rank, vec_id, score)"""
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        # Single precision travels as it is and is widened where scores are worked out.
        v = F.col("embedding")
        v = v if df.schema["embedding"].dataType.simpleString() == "array<float>" else v.cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return df.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))

    # The written tables fix the rows' numbers.
    rows = materialise(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    most = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.percentile_approx(most, 0.5).alias("mid")).agg(F.max(F.struct("n", "dim", "mid")).alias("m")).first()
    if dims is None or dims.m is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims.m.dim)
    scale = 2.0 ** -int(np.clip(np.floor(np.log2(dims.m.mid)), -1000, 1000))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * scale * (c.cast("double") * scale)))
    top = rows.agg(F.max(F.when(most * scale <= BIG, norm))).first()[0]
    centres, ratio, posted = index(rows, dims.m.n, top, scale)
    # Rows of each list that count it as their own: one number per list, of which there are 2 * MAX_LISTS at most.
    held = np.zeros(len(centres), np.int64)
    for r in posted.where(F.col("own_list").isNotNull()).groupBy("own_list").count().collect():
        held[r.own_list] = r["count"]

    asked = materialise(usable(queries).where(F.size("v") == dims.m.dim).withColumn("row", F.monotonically_increasing_id()), "queries")
    same = rows.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("same"))
    asked = asked.join(same, "vec_id", "left").select("row", "vec_id", "v", F.coalesce("same", F.lit(0)).alias("same"))
    asked = asked.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "row")
    kind = asked.schema["v"].dataType.simpleString()
    probes = materialise(asked.mapInArrow(_probe(centres, ratio, held, top, scale), f"grp int, bits long, own_list int, row long, vec_id long, v {kind}"), "probes")

    sizes = posted.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = probes.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    both = F.broadcast(sizes.join(asks, "grp"))  # one row per group, of which there are 2 * MAX_LISTS / 62 at most
    hashed = F.xxhash64("row")
    columns = ["bits", "row", "vec_id", "v"]
    right = posted.join(both, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(hashed, "blocks").cast("int").alias("j"), *columns)
    left = probes.join(both, "grp").select("grp", F.pmod(hashed, "parts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *columns)
    keys = ["grp", "i", "j"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_score, "q_row long, query_id long, row long, vec_id long, score double")
    # A row may come from several groups; its score is the same in each.
    once = scored.groupBy("q_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q_row", "query_id").orderBy(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")).desc(), "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
