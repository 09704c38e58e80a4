"""Removal of repeated 400-byte strings by bucket-pointer refinement.

A pointer is a place of a text where 400 bytes follow.  Pointers with equal strings must end in one bucket; whoever is not alone
there is repeated, and the bytes behind it go.
1. Initial buckets: the smallest of the 301 100-grams behind a pointer (by digest, first of equals) is its anchor.  Pointers with one
   anchor are consecutive and travel as one range; the digest of the anchor's 100-gram is the range's bucket.  Equal
   strings have their anchors at equal distances, so no pair of them is in different buckets.
2. Refinement: a bucket with one range is final.  Else its ranges are split by the identifiers of later (and earlier) offsets: one
   identifier names all bytes that the range's pointers reach.  Where it is the same for several ranges, their pointers are repeated.
   A bucket whose ranges all share it is done.
3. Recursion: in any other bucket one range of each identifier is cut at fixed distances from its anchor, to 43 pointers and then to 1,
   and each part gets the identifier of the bytes that all its pointers share as its bucket: at least 358, and at last all 400.
Identifiers are polynomial digests over prefix sums: the identifier of a longer string is put together from those of shorter ones
behind each other, as the ranks of a bucket sort would be, but means the same in every task.  They have 64 bits for the bucket
and 64 of another function within it.

Rows that move are one for each range (about 150 pointers), then those for the ends of repeated passages.  Texts are
dealt by row key once, into a bucketed table in the shared folder, and later passes join that table without moving texts.

Defined results: a null text is empty; texts under 400 bytes lose nothing; repeated rows are documents of their own, so both lose all
400-byte strings; null and repeated doc_ids pass through; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import by_bytes
from .common import materialise, prepare, shared_dir, table
from .shingles import _power_table, mix

WIDTH, GRAM = 400, 100
#: Pointers of a part, level by level; each is a multiple of the next.
LEVELS = (WIDTH - GRAM + 1, 43, 1)
CHUNK = 1 << 19
#: Fixed values of the two digest functions: a number for each byte.
_VALUES = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)
_RANGE = "row long, at int, first int, last int, core long, whole long"


class Digests:
    """Identifiers of substrings of joined texts."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        self.up, self.down = _power_table(len(data) + 1)
        self.total = []
        for values in _VALUES:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * self.up[: len(data)], out=total[1:])
            self.total.append(total)

    def of(self, start: np.ndarray, length, tag, function: int) -> np.ndarray:
        """Identifiers of the strings at ``start``; ``tag`` (a number) keeps apart what must not meet."""
        total = self.total[function]
        tag = np.asarray(tag, np.int64).astype(np.uint64)
        return mix((total[start + length] - total[start]) * self.down[start] + mix(tag + np.uint64(1)))

    def grams(self) -> np.ndarray:
        total = self.total[0]
        return (total[GRAM:] - total[:-GRAM]) * self.down[: len(total) - GRAM]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(digests: Digests, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first pointer, last pointer) of the ranges of joined texts."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    counts = np.maximum(lengths - (WIDTH - 1), 0)
    if not counts.sum():
        return (np.empty(0, np.int64),) * 4
    order = digests.grams()
    order = (order ^ (order >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=np.uint64)
    least = _sliding_minimum(order, LEVELS[0])
    text = np.repeat(np.arange(len(lengths)), counts)
    pointer = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    least = least[pointer]
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((new[1:], [len(least)])) - 1
    return text[new], (least[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), pointer[new], pointer[last]


def _batch(rows: pa.Array, digests: Digests, base: np.ndarray, at, first, last, low, width: int) -> pa.RecordBatch:
    """Ranges with identifiers; ``low`` is the least distance from the anchor of the part that the range belongs to."""
    core = digests.of(at - low, WIDTH - width + 1, low, 0)
    whole = digests.of(first, last - first + WIDTH, (at - first) * WIDTH + (at - last), 1)
    numbers = [pa.array((x - base).astype(np.int32)) for x in (at, first, last)]
    return pa.RecordBatch.from_arrays([rows, *numbers, pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], ["row", "at", "first", "last", "core", "whole"])


def _texts(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    texts = part.column("text").cast(pa.binary()).to_pylist()
    lengths = np.array([len(t) for t in texts], np.int64)
    return texts, lengths, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def _initial(batches):
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK):
            texts, lengths, starts = _texts(part)
            digests = Digests(b"".join(texts))
            text, at, first, last = anchors(digests, lengths)
            # The anchor's own 100-gram: the bytes that all pointers of the widest part share.
            yield _batch(part.column("row").take(pa.array(text)), digests, starts[text], at, first, last, np.zeros(len(at), np.int64), LEVELS[0])


def _parts(width: int):
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK):
                texts, _, starts = _texts(part)
                found = part.column("ranges")
                text = np.repeat(np.arange(len(texts)), np.asarray(found.value_lengths(), np.int64))
                at, first, last = (np.asarray(found.flatten().field(c), np.int64) + starts[text] for c in ("at", "first", "last"))
                low, high = (at - last) // width, (at - first) // width
                count = high - low + 1
                of = np.repeat(np.arange(len(at)), count)
                low = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]) * width
                first, last, at, text = np.maximum(first[of], at[of] - low - width + 1), np.minimum(last[of], at[of] - low), at[of], text[of]
                yield _batch(part.column("row").take(pa.array(text)), Digests(b"".join(texts)), starts[text], at, first, last, low, width)

    return run


def refine(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges whose pointers are all repeated, ranges to cut further) of written ranges.  Hot buckets are counted by partial sums and
    met by a join that splits them."""
    buckets = ranges.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    buckets = materialise(buckets, "buckets")  # a side of its own, so that Spark may split the other's hot keys
    live = materialise(ranges.join(buckets, "core").select(*ranges.columns, (F.col("low") != F.col("high")).alias("mixed")), "live")
    mixed = live.where("mixed")
    classes = materialise(mixed.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("one")), "classes")
    sure = live.where("not mixed").unionByName(mixed.join(classes.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi"), allowMissingColumns=True)
    return sure.select("row", "first", "last"), classes.select("one.*")


def _remove(batches):
    for batch in batches:
        size, removed, spans, digest, where = [], [], [], [], []
        for text, first, last in zip(batch.column("text").cast(pa.binary()), batch.column("firsts"), batch.column("lasts")):
            raw = text.as_py()
            kept, runs, end = [], [], 0
            if first.is_valid:
                a = np.asarray(first.values, np.int64)
                order = np.argsort(a)
                a, b = a[order], np.maximum.accumulate(np.asarray(last.values, np.int64)[order] + WIDTH)
                new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                runs = list(zip(a[new].tolist(), b[np.concatenate((new[1:] - 1, [len(b) - 1]))].tolist()))
            for p, q in runs:
                kept.append(raw[end:p])
                end = q
            kept.append(raw[end:])
            size.append(len(raw))
            removed.append(sum(q - p for p, q in runs))
            spans.append(len(runs))
            digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
            where.append(",".join(f"{p}:{q}" for p, q in runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(digest, pa.string()), pa.array(where, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def dealt(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of all rows, as a table bucketed by row in the shared folder: joins by row leave its texts in place."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.repartition(n, "row").write.bucketBy(n, "row").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(row, first, last): ranges of places in ``texts`` (row, text) whose 400-byte strings also start elsewhere."""
    ranges = materialise(texts.select("row", "text").mapInArrow(_initial, _RANGE), "ranges")
    sure, left = refine(ranges)
    for width in LEVELS[1:]:
        by_row = left.groupBy("row").agg(F.collect_list(F.struct("at", "first", "last")).alias("ranges"))
        ranges = materialise(texts.join(by_row, "row").select("row", "text", "ranges").mapInArrow(_parts(width), _RANGE), "ranges")
        more, left = refine(ranges)
        sure = sure.unionByName(more)
    return sure


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and removed ("start:end,..." in bytes)."""
    prepare(docs.sparkSession)
    texts = dealt(docs)
    spans = repeated_ranges(texts).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    spans = spans.select("row", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))
    joined = texts.join(spans, "row", "left").select("doc_id", "text", "firsts", "lasts")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")


def op11_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
