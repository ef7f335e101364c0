"""Stored tf-idf models: word weights, vectors and norms as Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources.store import Store

PARTS = ("idf", "postings", "norms")
FILE = "bag.json"


def _digest(df: DataFrame) -> list[int]:
    """Row count and an order-free checksum of all columns."""
    n, total = df.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({', '.join(sorted(df.columns))}))")).first()
    return [n, total or 0]


def dump(spark: SparkSession, model: dict[str, DataFrame], folder: str) -> None:
    """Write a model beside the one that is there, check it, then put its description in place.

    A crash leaves the old model whole, since its parts are touched only after
    the new description names the new parts.
    """
    store = Store(spark, folder)
    store.make()
    version = f"model-{uuid.uuid4().hex}"
    for part in PARTS:
        model[part].write.parquet(f"{store.folder}/{version}/{part}")
    digests = {part: _digest(spark.read.parquet(f"{store.folder}/{version}/{part}")) for part in PARTS}
    described = {"version": 1, "folder": version, "parts": digests}
    if not _sound(spark, store.folder, described):
        store.delete(version)
        raise OSError(f"{folder}: the parts just written cannot be read back")
    store.replace(FILE, json.dumps(described, sort_keys=True).encode())
    for name in store.names():
        if name.startswith("model-") and name != version:
            store.delete(name)


def _described(spark: SparkSession, folder: str) -> dict:
    return json.loads(Store(spark, folder).read(FILE))


def _sound(spark: SparkSession, folder: str, described: dict) -> bool:
    return all(_digest(spark.read.parquet(f"{folder}/{described['folder']}/{part}")) == described["parts"][part] for part in PARTS)


def verify(spark: SparkSession, folder: str) -> bool:
    try:
        return _sound(spark, folder, _described(spark, folder))
    except Exception:
        return False


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts of a stored model; raises where it fails its checksums."""
    if not verify(spark, folder):
        raise ValueError(f"{folder} holds no sound model")
    version = _described(spark, folder)["folder"]
    return {part: spark.read.parquet(f"{folder}/{version}/{part}") for part in PARTS}
