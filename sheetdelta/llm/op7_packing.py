"""Packing documents into fixed-length sequences by vector bin packing.

A document becomes its token ids and an end id.  It is cut at multiples of the longest piece; such pieces need no packing.  The
rest are items with three demands: tokens, one segment, and loss-bearing tokens (the first token of a segment
has no context, so it bears none).  Loss-bearing tokens have a lower limit than tokens, so that sequences of one long piece do
not weigh more in training than those of many: one of few segments is full before it has LENGTH tokens, and documents are cut
so that a piece by itself keeps both limits.  Bins open one at a time; each takes, again and again, the item that fits and has the
largest dot product of its demands with what the bin has left, both as shares of the limits and weighted by the mean demand.
Items are dealt to shards of bounded size, so that no task holds an unbounded group; each shard packs its own.

Defined results: a null text counts as empty and gives the single end id; repeated rows are packed each; null ``doc_id``
passes through; an empty table gives an empty result; further columns are ignored.  An item over a limit by itself (only
possible in the general interface) gets a sequence of its own; nothing is dropped.  Texts with very long runs of white space
or of one letter have the same ids as any other encoder of the file gives.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, BytePairCodec, byte_symbols
from .common import materialise, prepare, table

LENGTH, SEGMENTS, LOSS, END_ID = 1024, 64, 1016, 0
SHARD, MAX_TASKS = 20_000, 10_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: The faster encoder searches white space by backtracking, whose depth is bounded; longer runs go to the one of operator 4.
BLANK_RUN = 8_192
_blank_run = regex.compile(rf"\s{{{BLANK_RUN}}}")
_encoders: dict = {}


def encoder(path: str):
    """ids of a text by the tokenizer file.  A byte-level vocabulary whose ids follow its merge ranks is run by the faster
    of the two public libraries, which then gives the same ids; any other by the one that reads the file itself."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = [vocab[a + b] for a, b in pairs]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if ranked == sorted(ranked) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
            import tiktoken

            ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in special}
            e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            marks = re.compile("|".join(map(re.escape, special)) or r"(?!)")
            careful: list[BytePairCodec] = []

            def encode(t: str) -> list[int]:
                if len(t) >= BLANK_RUN and _blank_run.search(t):
                    if not careful:
                        careful.append(BytePairCodec(path))
                    return careful[0].encode(t)
                return e.encode(t, allowed_special="all") if marks.search(t) else e.encode_ordinary(t)

            _encoders[path] = encode
        else:
            from tokenizers import Tokenizer

            k = Tokenizer.from_file(path)
            k.no_padding()
            k.no_truncation()
            _encoders[path] = lambda t: k.encode(t, add_special_tokens=False).ids
    return _encoders[path]


def _cut(path: str, length: int):
    def run(batches):
        from sheetdelta.llm import op7_packing  # the worker's own module keeps the encoder between tasks

        encode = op7_packing.encoder(path)
        for batch in batches:
            row, start, size, crc, total = [], [], [], [], []
            for r, value in enumerate(batch.column("text")):
                ids = encode(value.as_py() or "")
                ids.append(END_ID)
                data = np.array(ids, "<u4").tobytes()
                for at in range(0, len(ids), length):
                    n = min(length, len(ids) - at)
                    row.append(r)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    total.append(len(ids))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, size, crc, total)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(path, length), PIECES)


def fill(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each item.  Items of equal demands are one class, so a choice looks at classes, not at items."""
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=len(kinds))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    share = kinds / limits
    weight = (share * count[:, None]).sum(0) / max(1, count.sum())
    out = np.empty(len(demands), np.int64)
    left_items, bin_no = int(count.sum()), -1
    alive = np.arange(len(kinds))
    while left_items:
        bin_no += 1
        room = limits.astype(np.float64).copy()
        opened = False
        open_kinds = alive
        while True:
            fits = open_kinds[(kinds[open_kinds] <= room).all(1) & (count[open_kinds] > 0)]
            if not len(fits):
                if opened:
                    break
                fits = open_kinds[count[open_kinds] > 0][:1]  # over a limit by itself
            score = share[fits] @ (weight * np.maximum(room, 0) / limits)
            k = fits[int(np.argmax(score))]
            out[order[first[k]]] = bin_no
            first[k] += 1
            count[k] -= 1
            room -= kinds[k]
            left_items -= 1
            opened, open_kinds = True, fits
        if bin_no % 64 == 0:
            alive = alive[count[alive] > 0]
    return out


def _pack_shard(limits: tuple[int, int, int]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable").reset_index(drop=True)
        bins = fill(frame[["tokens", "segments", "loss"]].to_numpy(np.int64), np.array(limits, np.int64))
        order = np.argsort(bins, kind="stable")
        done = frame.iloc[order].reset_index(drop=True)
        done["bin"] = bins[order]
        by = done.groupby("bin", sort=False)
        # A sequence is named after its first item, which is in no other.
        return pd.DataFrame({"item": done["item"], "sequence_id": by["item"].transform("first"), "offset": by["tokens"].cumsum() - done["tokens"]})

    return run


def pack(items: DataFrame, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LOSS)) -> DataFrame:
    """``items`` (item, tokens, loss; item unique, the table materialised) with sequence_id and offset under limits on
    tokens, segments and loss-bearing tokens."""
    prepare(items.sparkSession)
    shards = max(1, -(-items.count() // SHARD))
    dealt = items.select("item", "tokens", F.lit(1).cast("long").alias("segments"), "loss", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    # A task for each shard, as far as shards are not many more than the tasks of any other shuffle here.
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards, MAX_TASKS))
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(_pack_shard(limits), "item long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    longest = min(length, loss + 1)
    # The written table fixes the numbers of the pieces.
    cut = materialise(pieces(docs, path, longest).withColumn("item", F.monotonically_increasing_id()), "pieces")
    # Only segments without loss fit beside a piece of full length; a sequence of its own loses length - longest tokens at most.
    whole = cut.where(F.col("length") == longest)
    rest = cut.where(F.col("length") < longest)
    placed = pack(rest.select("item", F.col("length").alias("tokens"), (F.col("length") - 1).alias("loss")), (length, segments, loss))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*out[:5], F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).union(rest.join(placed, "item").select(*out))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the packed pieces of all documents."""
    return pack_documents(docs, vocabulary())


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
