"""BPE encoding and decoding of whole texts, with a vocabulary file given by path.

Defined results: a null text counts as empty (no ids, empty decoded text); a row per row, repeated rows and null ``doc_id``
included; an empty table gives an empty result; further columns are ignored.  The strings of special tokens in a text
become their ids, and decoding writes them out again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BytePairCodec
from .common import prepare, table

_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """The codec of a file, kept for the life of the Python worker."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches):
        from sheetdelta.llm import op4_bpe  # the worker's own module keeps the codec between tasks

        c = op4_bpe.codec(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column("text"):
                ids = c.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str):
    def run(batches):
        from sheetdelta.llm import op4_bpe

        c = op4_bpe.codec(path)
        for batch in batches:
            ids = [c.encode(v.as_py() or "") for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches):
        from sheetdelta.llm import op4_bpe

        c = op4_bpe.codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(v.as_py() or []) for v in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return run


def _narrow(df: DataFrame, value: str, kind: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(value).cast(kind).alias(value))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids)"""
    return _narrow(docs, "text", "string").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text)"""
    return _narrow(encoded, "ids", "array<int>").mapInArrow(_texts(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids or decoded texts out of the Python worker."""
    return _narrow(docs, "text", "string").mapInArrow(_encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
