"""Pinned models: tables of numbers under the digest of their content, checked whenever they are read.

``folder/name.pin`` names the digest; ``folder/name/<digest>`` holds the rows (part, i, value).  A model whose rows have another digest
than its pin, or lack a part, is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ROWS = "part string, i int, value double"


class PinError(ValueError):
    """A model is not the one that was pinned."""


def digest(model: dict[str, np.ndarray]) -> str:
    """SHA-256 over the names, shapes and numbers of the parts, in order of name."""
    h = hashlib.sha256()
    for name in sorted(model):
        part = np.ascontiguousarray(model[name], "<f8")
        h.update(f"{name}{list(part.shape)}".encode() + part.tobytes())
    return h.hexdigest()


def as_rows(spark: SparkSession, model: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(name, i, float(v)) for name in sorted(model) for i, v in enumerate(model[name].ravel())], ROWS)


def save_model(spark: SparkSession, model: dict[str, np.ndarray], folder: str, name: str) -> str:
    """Write and pin a model; the digest.  An equal model is the same table."""
    found = digest(model)
    as_rows(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/{found}")
    spark.createDataFrame([(name, found)], "name string, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.pin")
    return found


def pinned(spark: SparkSession, folder: str, name: str) -> str:
    rows = spark.read.schema("name string, digest string").json(f"{folder}/{name}.pin").collect()
    if len(rows) != 1 or rows[0].name != name or not rows[0].digest:
        raise PinError(f"{name} has no pin in {folder}")
    return rows[0].digest


def load_model(spark: SparkSession, folder: str, name: str, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The pinned model, if its numbers are those that were pinned."""
    want = pinned(spark, folder, name)
    most = sum(int(np.prod(s)) for s in shapes.values())
    rows = spark.read.schema(ROWS).parquet(f"{folder}/{name}/{want}").limit(most + 1).collect()
    numbers = {(r.part, r.i): r.value for r in rows}
    model = {}
    for part, shape in shapes.items():
        n = int(np.prod(shape))
        values = [numbers.get((part, i)) for i in range(n)]
        if None in values:
            raise PinError(f"{name} lacks numbers of {part}")
        model[part] = np.array(values, float).reshape(shape)
    if len(rows) != most or digest(model) != want:
        raise PinError(f"{name} differs from its pin {want[:8]}")
    return model


def pipeline_version(spark: SparkSession, folder: str, code: str = "1", classifier: str = "classifier", encoder: str = "encoder") -> str:
    """What made a report: the version of the code and the first eight digits of both models' digests."""
    return f"{code}+classifier.{pinned(spark, folder, classifier)[:8]}+encoder.{pinned(spark, folder, encoder)[:8]}"
