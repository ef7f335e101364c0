"""Where a session keeps what driver and executors must both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset a session on one machine gets a temporary folder; on a
    cluster no folder can be guessed, so an error is raised.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillmatch-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A name in the shared folder that no one else has."""
    return f"{shared_folder(spark)}/quillmatch-{uuid.uuid4().hex}"
