"""Importance resampling of documents towards the distribution of a target table, by hashed word n-grams.

Words are runs of ASCII letters (lowered), digits and non-ASCII characters; features are all runs of one to three words, hashed to
BUCKETS buckets by CRC-32.  A bucket's gain is the log ratio of its share in the target and in the documents; a document's weight is
the sum of its features' gains, and Gumbel noise from a digest of its doc_id turns weights into a draw without replacement.

Features are found in a suffix array of word ids per batch of texts: places are sorted by the ids of their next three words (deeper
order does not matter to n-grams of three), the common prefix of neighbours (0 to 3 words) marks the runs of equal n-grams, each run
is hashed once, and the run's bucket is scattered back to its places.  CRCs of longer n-grams are put together from those
of their words.  Texts are read twice: for the counts of buckets, and for weights.  Only BUCKETS numbers come to the driver.

Defined results: a null text has no words, weight 0, and is never drawn; a null doc_id takes the noise of the empty string; repeated
rows are drawn each, in any order among themselves; ties go to the smaller doc_id, none last; without target or documents all counts
are 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.operators.ranking import ranked

from .arrow import by_bytes
from .common import materialise, prepare, table

BUCKETS, DEPTH, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
CHUNK = 1 << 21
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 0 for c in range(256))
_BITS = np.uint32(1) << np.arange(32, dtype=np.uint32)


@lru_cache(4096)
def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) that carry the CRC of a string over ``length`` further bytes; XOR the CRC of these bytes."""
    zeros = bytes(1)
    if length == 0:
        images = _BITS
    elif length == 1:
        start = zlib.crc32(zeros)
        images = np.array([zlib.crc32(zeros, int(b)) ^ start for b in _BITS], np.uint32)
    else:
        half = length // 2
        images = carry(carry(_BITS, half), half)
        if length % 2:
            images = carry(images, 1)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit : 2 << bit] = out[k, : 1 << bit] ^ images[8 * k + bit]
    return out


def carry(crc: np.ndarray, length: int) -> np.ndarray:
    t = _shift(length)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def _then(crc: np.ndarray, word: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of strings followed by a blank and a word."""
    crc = carry(crc, 1) ^ np.uint32(zlib.crc32(b" "))
    size = sizes[word]
    order = np.argsort(size, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if a < b:
            at = order[a:b]
            crc[at] = carry(crc[at], int(size[at[0]]))
    return crc ^ crcs[word]


class Grams:
    """Words of texts, and the bucket of the n-grams of each depth that begin at each word (-1: the text ends before)."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\0".join(texts).translate(_FOLD) + b"\0", np.uint8)
        word = data > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        stops = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate(([0], np.searchsorted(start, stops, "left")))
        n = len(start)
        self.buckets = np.full((DEPTH, n), -1, np.int32)
        if not n:
            return
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        vocabulary = words.dictionary.to_pylist()
        crcs = np.array([0, *map(zlib.crc32, vocabulary)], np.uint32)
        sizes = np.array([0, *map(len, vocabulary)], np.int64)
        ids = np.zeros((DEPTH, n + DEPTH), np.int64)
        ids[0, :n] = np.asarray(words.indices) + 1
        ended = np.zeros(n + DEPTH, bool)
        ended[self.bounds[1:]] = True  # words here and later belong to the next text
        stopped = np.zeros(n, bool)
        for k in range(1, DEPTH):
            stopped |= ended[k : k + n]
            ids[k, :n] = np.where(stopped, 0, ids[0, k : k + n])
        ids = ids[:, :n]
        self._scatter(ids, self._order(ids, len(vocabulary)), crcs, sizes)

    @staticmethod
    def _order(ids: np.ndarray, most: int) -> np.ndarray:
        """The suffix array, to a depth of DEPTH words."""
        width = most.bit_length()
        if width * DEPTH > 63:
            return np.lexsort(ids[::-1])
        key = ids[0]
        for k in range(1, DEPTH):
            key = key << width | ids[k]
        return np.argsort(key)

    def _scatter(self, ids: np.ndarray, order: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> None:
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in range(DEPTH):
            at = ids[k][order]
            new[1:] |= at[1:] != at[:-1]  # the common prefix with the place before has k words at most
            runs = np.flatnonzero(new)
            first = order[runs]
            crc = crcs[ids[0][first]]
            for j in range(1, k + 1):
                crc = _then(crc, ids[j][first], crcs, sizes)
            bucket = np.where(ids[k][first] > 0, (crc % np.uint32(BUCKETS)).astype(np.int32), -1)
            self.buckets[k, order] = np.repeat(bucket, np.diff(np.concatenate((runs, [len(order)]))))


def _grams(batch: pa.RecordBatch):
    for part in by_bytes(batch, "text", CHUNK):
        yield part, Grams(part.column("text").fill_null("").cast(pa.binary()).to_pylist())


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, g in _grams(batch):
            total += np.bincount(g.buckets[g.buckets >= 0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def _weigh(gains: list[int]):
    def run(batches):
        gain = np.array([*gains, 0], np.int64)  # the last is met by -1
        for batch in batches:
            for part, g in _grams(batch):
                total = np.concatenate(([0], np.cumsum(gain[g.buckets].sum(0))))
                found = np.concatenate(([0], np.cumsum((g.buckets >= 0).sum(0))))
                a, b = g.bounds[:-1], g.bounds[1:]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (b - a, found[b] - found[a], total[b] - total[a])]], ["doc_id", "n_words", "n_features", "weight"]
                )

    return run


def bucket_counts(texts: DataFrame) -> list[int]:
    """Features of all texts in each bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * BUCKETS
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    s, t = sum(source), sum(target)
    return [floor(1000 * log(float(b + 1) * float(s + BUCKETS) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(source, target)]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: str = "42") -> DataFrame:
    """For every row of ``docs``: doc_id, n_features, weight, score, rank in the draw (null: not drawn) and n_words."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    able = F.col("n_words") >= LEAST_WORDS
    scored = materialise(weighed.withColumns({"score": F.col("weight") + noise, "_able": able, "_row": F.monotonically_increasing_id()}), "scores")
    drawn = scored.where("_able").count() * percent // 100
    place = ranked(scored, [F.desc("_able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")], "rank")
    return place.select("doc_id", "n_features", "weight", "score", F.when(F.col("_able") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"), "n_words")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
