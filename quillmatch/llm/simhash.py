"""SimHash near-dedup with pivot distance tables (operator 9).

Every whole text gets a 64-bit fingerprint from the hashes of its word
shingles.  Distinct fingerprints within ``MAX_BITS`` bits are linked, and the
documents of a connected group share its smallest id.

Pairs: fingerprints that differ in at most k bits agree on at least b - k of
any b blocks of bits, so they meet in a bucket of one of the C(b, b-k) choices
of blocks.  b grows with the number of fingerprints, so that chance buckets
stay small; every b finds every pair.  Inside a bucket a table holds each
fingerprint's Hamming distance to ``PIVOTS`` reference fingerprints.  By the
triangle inequality a pair whose distances to any one reference differ by more
than k is not a link: rows sorted by the first coordinate are compared within
a window of k only, the other coordinates discard pair after pair, and what
survives is verified bit by bit.  Buckets above ``BUCKET_ROWS`` are dealt as
pairs of chunks to several tasks.  A task answers with a spanning forest of
its links, and alternating stars join the forests of all tasks.

Defined cases: a null or blank text has fingerprint 0 and is linked like any
other; rows with equal fingerprints are one vertex, however many; a null id
never is a group's smallest unless all are null; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import hub_join, if_small, pinned, positional, shuffle_width

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
PIVOTS = 24
BUCKET_ROWS = 1024
#: Most fingerprints that chance alone should bring into one bucket.
CHANCE_ROWS = 64

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by a fixed hash."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", HASH_SEED) for k in range(n)], np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    n, lanes = len(hashes), hashes.view(np.uint8).reshape(-1, 8)
    if n < 200:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint's bits as a signed number."""
    return F.pandas_udf(_fingerprints, "long")(text)


def block_masks(n_blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks over which a pair within ``max_bits`` agrees at least once, as signed numbers."""
    edges = np.linspace(0, 64, n_blocks + 1).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, n_blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Fewest blocks whose chance buckets hold at most ``CHANCE_ROWS`` of n fingerprints."""
    b = max_bits + 1
    while b < 2 * max_bits + 2 and n / 2 ** (64 * (b - max_bits) // b) > CHANCE_ROWS:
        b += 1
    return b


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row each of n rows is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(label, before):
            return label


def bucket_forest(group: np.ndarray, chunk: np.ndarray, cross: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS, counts: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a spanning forest) among rows of equal ``group``.

    Rows of a group marked ``cross`` are only compared between its two chunks.
    ``counts`` sums the pairs within the first pivot's window, those left by
    the other pivots, and those verified.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, chunk, cross, prints, table = group[order], chunk[order], cross[order], prints[order], table[order]
    first = table[:, 0]
    n = len(prints)
    label = np.arange(n)
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    held = 0
    active = np.arange(n)
    step = 0
    while len(active):
        step += 1
        active = active[active < n - step]
        other = active + step
        near = (group[active] == group[other]) & (first[other] - first[active] <= max_bits)
        active, other = active[near], other[near]
        a, b = active, other
        apart = ~cross[a] | (chunk[a] != chunk[b])
        a, b = a[apart], b[apart]
        met = len(a)
        for k in range(1, table.shape[1]):
            if not len(a):
                break
            keep = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
        if counts is not None:
            counts.update({"met": met, "left by pivots": len(a), "verified": int(keep.sum())})
        if keep.any():
            lefts.append(a[keep])
            rights.append(b[keep])
            held += int(keep.sum())
        if held > 1_000_000:
            label = _forest(n, np.concatenate(lefts), np.concatenate(rights))
            own = np.flatnonzero(label != np.arange(n))
            lefts, rights, held = [own], [label[own]], len(own)
    if held:
        label = _forest(n, np.concatenate(lefts), np.concatenate(rights))
    own = np.flatnonzero(label != np.arange(n))
    return prints[own], prints[label[own]]


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a partition sorted by (mask, key, a, b); a cut group waits for its rest."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def answer(columns: list[np.ndarray]) -> pa.RecordBatch:
        mask, key, a, b, chunk, prints = columns
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(mask) != 0) | (key[1:] != key[:-1]) | (np.diff(a) != 0) | (np.diff(b) != 0)
        u, v = bucket_forest(np.cumsum(new), chunk, a != b, prints.view(np.uint64))
        u, v = u.view(np.int64), v.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=schema)

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        last = np.ones(len(columns[0]), bool)
        for c in columns[:4]:
            last &= c == c[-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield answer([c[:cut] for c in columns])
    if held is not None:
        yield answer(held)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A spanning forest (u, v), u > v, of the links among distinct fingerprints (column ``fp``)."""
    spark = prints.sparkSession
    masks = block_masks(blocks_for(prints.count(), max_bits), max_bits)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x"))
    keys = keys.select("x.mask", "x.key", "fp")
    shared = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keys.join(shared, ["mask", "key"])
    chunks = F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("mask", "key", F.least("chunk", "j").alias("a"), F.greatest("chunk", "j").alias("b"), "chunk", "fp")
    dealt = met.repartition(shuffle_width(spark), "mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b")
    return dealt.mapInArrow(_link_partition, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v): alternating stars.

    A round hangs every node's larger neighbours, then its smaller ones, on its
    smallest neighbour; it ends when a round changes nothing.  Neighbours are
    never gathered in one row or task.
    """
    edges = pinned(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hub_join(both.filter("v > u"), least, "u", "v", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hub_join(large, least, "u", "v", 2 * rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        linked = hub_join(large, least, "u", "v", 2 * rows).filter("v <> m").select("u", F.col("m").alias("v"))
        edges = pinned(small.unionByName(linked).filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == state:
            break
        state, rows = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """Rows (fp, component_id, group_rows) from pinned rows (doc_id, fp)."""
    distinct = pinned(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = pinned(components(links(distinct.select("fp"), max_bits)))
    joined = pinned(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", "root"))
    alone = joined.filter("root is null").select("fp", F.col("first_id").alias("component_id"), F.col("n").alias("group_rows"), F.col("fp").alias("root"))
    linked = joined.filter("root is not null")
    heads = pinned(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("group_rows")))
    return pinned(alone.unionByName(hub_join(linked.select("fp", "root"), heads, "root", "fp", heads.count()).select("fp", "component_id", "group_rows", "root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fp, component_id, group_rows), one per document."""
    prints = pinned(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_of(F.col(f"`{text_col}`")).alias("fp")))
    return prints.join(_groups(prints, max_bits), "fp").select("doc_id", "fp", "component_id", "group_rows")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, whole: of each group the one with the smallest id.

    Rows of groups of one are told apart by an anti join against the grouped
    rows' (id, text hash), which is broadcast only if it has few rows.
    """
    rows, (id_name, text) = positional(docs, id_col, text_col)
    doc_id, mark = F.col(id_name), F.xxhash64(F.col(text))
    prints = pinned(rows.select(doc_id.alias("doc_id"), mark.alias("mark"), fingerprint_of(F.col(text)).alias("fp")))
    grouped = prints.join(_groups(prints.select("doc_id", "fp"), max_bits).filter("group_rows > 1"), "fp")
    grouped = pinned(grouped.select(F.col("doc_id").alias("__i"), F.col("mark").alias("__m"), F.col("root").alias("__r")))
    first = grouped.groupBy("__r").agg(F.min(F.struct(F.col("__i").isNull(), "__i", "__m")).alias("__f"))
    first = first.select("__r", F.col("__f.__i").alias("__i"), F.col("__f.__m").alias("__m"))
    marked = rows.withColumn("__mark", mark)
    same = doc_id.eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m"))
    first, seen = pinned(first), pinned(grouped.select("__i", "__m").distinct())
    alone = marked.join(if_small(seen), same, "left_anti").select(rows.columns)
    chosen = marked.join(if_small(first), same).dropDuplicates(["__r"]).select(rows.columns)
    return alone.unionByName(chosen).toDF(*docs.columns)
