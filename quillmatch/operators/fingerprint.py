"""Winnowed fingerprints and content hashes of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.spooky import content_hex, hash64_of_tokens
from quillmatch.functions.text import Words, tokens

try:  # a third less time for short inputs
    from _md5 import md5
except ImportError:
    from hashlib import md5

BASIS, PRIME = 1469598103934665603, 1099511628211
TOKEN_CAP = 4_000_000


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """FNV-style hash of every run of k unsigned token hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, BASIS, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(PRIME)
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least gram of every full window, each once."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    # Windows over the reversed row: the first least is the rightmost.
    places = len(grams) - 1 - (np.arange(len(windows)) + windows.argmin(1))
    return np.unique(places)


def fingerprints(docs: DataFrame, text: Column, key: str, k: int, w: int, mode: str = "file", chunk_bytes: int | None = None, token_cap: int = TOKEN_CAP) -> DataFrame:
    """Rows (key, pos, fp, start_line, end_line); fp holds the unsigned bits.

    k and w below 1 count as 1; texts with fewer grams than w have none.  A
    batch's tokens are hashed together, each different one once.
    """
    k, w = max(1, k), max(1, w)
    rows = docs.select(F.col(key), tokens(text, mode, chunk_bytes).alias("t")).select(key, F.slice("t.line", 1, token_cap).alias("lines"), F.slice("t.token", 1, token_cap).alias("toks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).flatten().dictionary_encode()
            known = hash64_of_tokens(coded.dictionary.to_pylist()) if len(coded) else np.zeros(0, np.uint64)
            hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else known
            lines = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column(2).value_lengths().fill_null(0).to_pylist()
            at, found = 0, []
            for row, n in enumerate(sizes):
                grams = gram_hashes(hashes[at : at + n], k)
                places = winnow(grams, w)
                found.append((np.full(len(places), row), places, grams[places], lines[at + places], lines[at + places + k - 1] if len(places) else lines[:0]))
                at += n
            if not found:
                continue
            row, places, fps, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(places.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=[key, "pos", "fp", "start_line", "end_line"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, fp long, start_line int, end_line int")


def _picked(digests: list[bytes], w: int) -> np.ndarray:
    """Places of the rightmost least digest of every full window, each once."""
    if len(digests) < w:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    high, low = raw[:, 0], raw[:, 1]
    order = np.lexsort((low, high))
    new = np.ones(len(order), np.int64)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = new.cumsum()
    return winnow(ranks, w)


def winnow_rows(docs: DataFrame, text: Column, key: str, k: int, w: int) -> DataFrame:
    """The same selection over MD5 grams: rows (key, pos, fp, start_line, end_line) with fp as hex digits.

    It is the form that plain SQL engines can share.  A text is cut into words
    and winnowed where it is read, so no token is shuffled or sorted; a key
    stands for one row.
    """
    k, w = max(1, k), max(1, w)
    rows = docs.select(F.col(key), text.cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found, prints = [], []
            for row, raw in enumerate(batch.column(1)):
                toks, lines = known.of_file(raw.as_py() or b"")
                sizes = np.fromiter(map(len, toks), np.int64, len(toks)) + 1
                ends = sizes.cumsum() - 1
                whole = b" ".join(toks)
                # Words hold no space: a gram is a piece of the words joined.
                digests = [md5(whole[a:z]).digest() for a, z in zip((ends + 1 - sizes).tolist(), ends[k - 1 :].tolist())]  # noqa: B905
                places = _picked(digests, w)
                found.append((np.full(len(places), row), places, lines[places], lines[places + k - 1]))
                prints += [digests[i].hex() for i in places.tolist()]
            if not found:
                continue
            row, places, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(places.astype(np.int32)), pa.array(prints, pa.string()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=[key, "pos", "fp", "start_line", "end_line"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, fp string, start_line int, end_line int")


def containment(prints: DataFrame, key: str = "doc_id", least: float = 0.5, max_df: int | None = None) -> DataFrame:
    """Pairs (a, b, shared, containment): the share of a's fingerprints that b has.

    ``max_df`` leaves out fingerprints of more documents than that.
    """
    own = prints.select(key, "fp").distinct()
    if max_df is not None:
        own = own.join(own.groupBy("fp").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_df).select("fp"), "fp")
    sizes = own.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    a, b = own.withColumnRenamed(key, "a"), own.withColumnRenamed(key, "b")
    shared = a.join(b, "fp").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(sizes.withColumnRenamed(key, "a"), "a").withColumn("containment", F.col("shared") / F.col("size"))
    return scored.filter(F.col("containment") >= least).select("a", "b", "shared", "containment")


def content_hash(docs: DataFrame, content: Column, key: str) -> DataFrame:
    """Rows (key, content_hash): 32 hex digits of the whole content."""
    return docs.select(key, content_hex(content).alias("content_hash"))
