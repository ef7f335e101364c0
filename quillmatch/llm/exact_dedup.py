"""Exact dedup by Golomb-coded fingerprint exchange (operator 4).

Hashes, digests and ids of all rows are written down once, with the number of
their sender: a run of up to ``SENDER_ROWS`` rows of one partition.  Every sender
sorts its distinct hashes and sends them to the owners of the hash ranges as
Golomb-Rice coded gaps.  An owner merges the lists it receives, finds the
hashes that came twice and answers every sender with a bitmap, one bit for each
hash it sent.  Rows whose bit is unset are unique and their texts are never
shuffled; the others ("suspects") are shuffled and verified by the bytes of
their text.  There are as many owners as rows need, so an owner holds about
``OWNER_HASHES`` hashes at any size.

Defined cases: a null text counts as empty; a null id sorts below all ids;
rows equal in text and id are copies of each other, one of them stays; an
empty table gives an empty result; further columns, whatever their names, are
passed through untouched by :func:`drop_exact_duplicates`.

:func:`suspect_test` is the same exchange for callers whose rows are too many
and too small to be written down (chunks of texts): owners answer with one
bitmap of slots for all, which can only be set too often, never too seldom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.common import discard, fresh_folder, hub_join, if_small, pinned, positional, power_of_two_at_least, shuffle_width, stored

#: Rows of one sender, and about how many hashes one owner merges.
SENDER_ROWS = 500_000
OWNER_HASHES = 4_000_000
#: Hashes of suspects that are broadcast at most, to pick their texts where they are read.
BROADCAST_HASHES = 2_000_000
#: Largest size of all slots of :func:`suspect_test` together: 2**30 bits are 128 MB.
MAX_FILTER_BITS = 30
#: Slots for each row; one in 16 unique rows at most is taken for a suspect.
SLOTS_PER_ROW = 16

_LISTS = "sender long, owner long, n long, width int, unary binary, rests binary, repeated binary"


def rice_encode(values: np.ndarray, universe_bits: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct unsigned values below 2**universe_bits.

    Returns the remainder width, the unary quotients and the remainders; the
    two streams are kept apart so that both decode without a loop.
    """
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    width = max(0, min(62, universe_bits - max(1, n).bit_length()))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 0
    if width:
        shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
        rests = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    else:
        rests = np.zeros(0, np.uint8)
    return width, np.packbits(unary).tobytes(), np.packbits(rests).tobytes()


def rice_decode(n: int, width: int, unary: bytes, rests: bytes) -> np.ndarray:
    """Inverse of :func:`rice_encode`."""
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    if width:
        bits = np.unpackbits(np.frombuffer(rests, np.uint8), count=n * width).reshape(n, width)
        low = np.zeros(n, np.uint64)
        for k in range(width):
            low = (low << np.uint64(1)) | bits[:, k]
        gaps = (gaps << np.uint64(width)) | low
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_bits(spark, rows: int) -> int:
    """Bits of a hash that name its owner."""
    return power_of_two_at_least(max(shuffle_width(spark), -(-rows // OWNER_HASHES))).bit_length() - 1


def _lists(hashes: np.ndarray, sender: int, owner_bits: int) -> pd.DataFrame:
    """One row for each owner that this sender has hashes of."""
    values, counts = np.unique(hashes.astype(np.int64).view(np.uint64), return_counts=True)
    range_bits = 64 - owner_bits
    owners = (values >> np.uint64(range_bits)) if owner_bits else np.zeros(len(values), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(values) else []
    rows = []
    for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
        low = values[a:b] & np.uint64((1 << range_bits) - 1)
        rows.append((sender, int(owners[a]), int(b - a), *rice_encode(low, range_bits), np.packbits(counts[a:b] > 1).tobytes()))
    return pd.DataFrame(rows, columns=["sender", "owner", "n", "width", "unary", "rests", "repeated"])


def _merged(lists: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The lists of one owner, decoded, and the sorted hashes among them that came twice."""
    values, found = [], []
    for row in lists.itertuples(index=False):
        got = rice_decode(row.n, row.width, row.unary, row.rests)
        values.append(got)
        found.append(got[np.unpackbits(np.frombuffer(row.repeated, np.uint8), count=row.n).astype(bool)])
    distinct, counts = np.unique(np.concatenate(values), return_counts=True)
    return values, np.union1d(distinct[counts > 1], np.concatenate(found))


def _answers(lists: pd.DataFrame) -> pd.DataFrame:
    """For every sender of an owner one bit for each hash it sent, in the order of its list."""
    values, twice = _merged(lists)

    def bits(own: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        return np.packbits(twice[at] == own if len(twice) else np.zeros(len(own), bool)).tobytes()

    return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "n": lists["n"], "bits": [bits(v) for v in values]})


def _marked_rows(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A sender's rows with what the owners answered about their hashes."""
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    own, place = np.unique(hashes, return_inverse=True)
    answers = answers.sort_values("owner")  # owners hold rising ranges, as the list was sorted
    parts = [np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.n) for r in answers.itertuples(index=False)]
    suspect = np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(bool)
    if len(suspect) != len(own):
        raise ValueError("an owner's answer is missing")
    return rows[["id", "sha", "hash"]].assign(suspect=suspect[place])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their sender as the last column."""
    n, part = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        sender = (n + np.arange(batch.num_rows)) // SENDER_ROWS + part
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sender, pa.int64())], names=["id", "sha", "hash", "sender"])


def exchanged(slim: DataFrame) -> DataFrame:
    """Rows (id, sha, hash, suspect) of rows (id, sha, hash), after the exchange."""
    spark = slim.sparkSession
    folder = fresh_folder(spark)
    rows = stored(slim.mapInArrow(_numbered, T.StructType([*slim.schema.fields, T.StructField("sender", T.LongType())])), folder)
    owner_bits = _owner_bits(spark, rows.count())

    def send(own: pd.DataFrame) -> pd.DataFrame:
        return _lists(own["hash"].to_numpy(), int(own["sender"].iloc[0]), owner_bits)

    lists = rows.select("sender", "hash").groupBy("sender").applyInPandas(send, _LISTS)
    answers = lists.groupBy("owner").applyInPandas(_answers, "sender long, owner long, n long, bits binary")
    schema = T.StructType([*slim.schema.fields, T.StructField("suspect", T.BooleanType())])
    marked = pinned(rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(_marked_rows, schema))
    discard(spark, folder)
    return marked


def _encode_partition(owner_bits: int):
    """The lists of a partition, as of one sender."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = _lists(np.concatenate(held), 0, owner_bits)
            return pa.RecordBatch.from_pandas(rows.astype({"width": np.int32}), preserve_index=False)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= OWNER_HASHES:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return encode


def _find_duplicates(owner_bits: int, slot_bits: int):
    """The bitmap of an owner's slots: set where a hash came more than once."""

    def find(lists: pd.DataFrame) -> pd.DataFrame:
        bitmap = np.zeros(1 << (slot_bits - owner_bits), np.uint8)
        bitmap[(_merged(lists)[1] >> np.uint64(64 - slot_bits)).astype(np.int64)] = 1
        return pd.DataFrame({"owner": [lists["owner"].iloc[0]], "bits": [np.packbits(bitmap).tobytes()]})

    return find


def suspect_test(hashes: DataFrame, rows: int, max_filter_bits: int = MAX_FILTER_BITS, slots_per_row: int = SLOTS_PER_ROW):
    """Slot bits and the broadcast bitmap of hashes (one long column) that repeat.

    ``rows`` is about how many hashes there are; it only sets the bitmap's size.
    """
    spark = hashes.sparkSession
    owner_bits = _owner_bits(spark, rows)
    slot_bits = min(max_filter_bits, (slots_per_row * max(1, rows)).bit_length())
    slot_bits = max(slot_bits, owner_bits + 3)
    lists = hashes.mapInArrow(_encode_partition(owner_bits), _LISTS)
    answers = lists.groupBy("owner").applyInPandas(_find_duplicates(owner_bits, slot_bits), "owner long, bits binary")
    bitmap = np.zeros((1 << owner_bits, (1 << (slot_bits - owner_bits)) // 8), np.uint8)
    for row in answers.toLocalIterator():
        bitmap[row.owner] = np.frombuffer(row.bits, np.uint8)
    return slot_bits, spark.sparkContext.broadcast(bitmap.reshape(-1))


def in_bitmap(hashes: np.ndarray, slot_bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Which of some signed 64-bit hashes fall on a set slot."""
    slots = (hashes.view(np.uint64) >> np.uint64(64 - slot_bits)).astype(np.int64)
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def _groups(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (sha, n, keep) of the suspects' groups, verified by the bytes of ``texts`` (sha, text)."""
    groups = marked.filter("suspect").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    by_bytes = texts.groupBy("sha", "text").agg(F.lit(1).alias("one")).groupBy("sha").agg(F.count(F.lit(1)).alias("texts"))
    n = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("n"))
    return groups.join(by_bytes, "sha").select("sha", n.alias("n"), "keep")


def _suspect_hashes(marked: DataFrame) -> DataFrame:
    return if_small(pinned(marked.filter("suspect").select("hash").distinct()), BROADCAST_HASHES)


def _keys(text: Column) -> list[Column]:
    return [F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("hash")]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its group's size, the id that stays, whether this row stays."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = exchanged(docs.select(F.col(f"`{id_col}`").alias("id"), *_keys(text)))
    texts = docs.select(*_keys(text), text.alias("text")).join(_suspect_hashes(marked), "hash", "left_semi")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = marked.filter("not suspect").select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    # Rows equal in text and id are one counted row until they are dealt out again.
    copies = marked.filter("suspect").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("m"))
    grouped = (
        hub_join(copies, _groups(marked, texts), "sha", "id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
        .select(
            F.col("id").alias("doc_id"),
            F.col("keep").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    return single.select(out).unionByName(grouped.select(out))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, (doc_id, text_name) = positional(docs, id_col, text_col)
    text = F.coalesce(F.col(text_name), F.lit(""))
    marked = exchanged(rows.select(F.col(doc_id).alias("id"), *_keys(text)))
    hashes = _suspect_hashes(marked)
    keyed = rows.withColumns(dict(zip(("sha", "hash"), _keys(text), strict=True)))
    suspects = keyed.join(hashes, "hash", "left_semi")
    groups = _groups(marked, suspects.select("sha", text.alias("text"))).withColumnRenamed("sha", "group")
    stays = suspects.join(groups, (F.col("sha") == F.col("group")) & F.col(doc_id).eqNullSafe(F.col("keep"))).dropDuplicates(["sha"])
    alone = keyed.join(hashes, "hash", "left_anti")
    return alone.select(rows.columns).unionByName(stays.select(rows.columns)).toDF(*docs.columns)
