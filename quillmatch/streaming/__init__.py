"""Matching of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillmatch.operators.match import PatternSet, find_matches


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def match_stream(documents: DataFrame, patterns: PatternSet, out: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Matches of every new document, a folder per micro-batch.

    A batch that is repeated after a failure replaces its own folder, so each
    document's matches are there once.  The pattern set is fixed for the
    stream; its generation is written beside the matches.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = find_matches(batch, patterns, F.col(text), key).withColumn("generation", F.lit(patterns.generation))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
