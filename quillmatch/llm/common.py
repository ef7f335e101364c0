"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources.scratch import fresh_folder, shared_folder
from quillmatch.sources.store import Store

#: One white-space rule for every word count: space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike :func:`pinned` the copy is columnar, which suits whole documents.
    """
    spark = df.sparkSession
    path = folder or fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`stored` wrote and nothing reads any more."""
    Store(spark, folder).delete("")


#: Rows of a narrow table (a few numbers or short strings each) that are broadcast at most.
BROADCAST_ROWS = 200_000


def if_small(narrow: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A pinned narrow table, marked for broadcast only if it has few rows.

    A pinned table has no size that the optimiser knows, so it is counted;
    beyond ``max_rows`` the join stays a shuffled one that Spark can split.
    """
    return F.broadcast(narrow) if narrow.limit(max_rows + 1).count() <= max_rows else narrow


#: Parts that the rows of one hub of a join are dealt to.
SALTS = 8


def hub_join(many: DataFrame, few: DataFrame, key: str, spread_by: str, rows: int | None = None) -> DataFrame:
    """``many`` joined to the one row of ``few`` that has its ``key``, a hot key's rows in ``SALTS`` parts.

    Where ``few`` is known to have no more than ``rows`` rows, few enough, it is broadcast.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions a shuffle of this session deals to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two_at_least(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def positional(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns ``__c0``, ``__c1``, ... and the new names of ``columns``.

    Operators that pass rows through work under these names, so no column of
    theirs can clash with one of the table's; ``toDF`` gives the old names back.
    """
    names = [f"__c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]
