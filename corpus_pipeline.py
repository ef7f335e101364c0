"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokens.

``STAGES`` are applied in order, each to all its predecessor kept; every stage
but the last returns the columns of ``documents``.  :func:`run` writes each
stage's rows as Parquet into the shared folder and reads them back, so a lost
executor never reaches back over a stage.

Nulls, empty texts, repeated rows and empty tables have the results that the
operators' modules define; documents without a letter are rejected by the
first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import bpe, exact_dedup, langid, mixing, simhash
from quillmatch.llm.common import discard, stored
from quillmatch.llm.queries import word_bpe_path
from quillmatch.sources.scratch import fresh_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of the labelled ones."""
    model = langid.train(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    return langid.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the row with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share takes it."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed document, with a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), word_bpe_path(), decoded_col="decoded")
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither language ID, SimHash nor BPE; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; a stage's rows are deleted once the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = fresh_folder(spark)
        docs = stored(stage(spark, docs, sf_dir), folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
