"""Whole files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) of all files under a path, empty ones too.

    The binary reader passes over empty files, so those are added from the
    folder's listing; unreadable and missing files, and a missing path, give
    no row.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(conf)
    if not system.exists(top):
        return spark.createDataFrame([], "path string, content binary")
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(path).select("path", "content")
    listing = system.listFiles(top, True)
    empty = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            empty.append((status.getPath().toString(),))
    if not empty:
        return full
    return full.unionByName(spark.createDataFrame(empty, "path string").withColumn("content", F.lit(b"")))


def content_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (path, content_hash) for named files; one that cannot be read has zeros."""
    from quillmatch.functions.spooky import NO_CONTENT, content_hex

    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    found = None
    for p in dict.fromkeys(paths):
        one = read_files(spark, p).select(F.lit(p).alias("path"), content_hex(F.col("content")).alias("content_hash"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return asked.withColumn("content_hash", F.lit(NO_CONTENT))
    return asked.join(found, "path", "left").fillna({"content_hash": NO_CONTENT})
