"""Substring dedup by content-defined chunking (operator 2).

A gear hash rolls over the bytes of a text; where a character ends and the hash
is least among those within ``RADIUS`` bytes, a chunk ends.  The hash depends
on the last ``WINDOW`` bytes only, so an insertion moves no boundary but those
beside it, and a passage that two texts share is cut alike in both.  Minima lie
more evenly than places below a bound, so fewer passages miss whole chunks.  Text
with a period of up to ``RADIUS`` bytes has no such place; it is cut into whole
periods from its least hash on, and its chunks are told apart by their number
up to ``LONGEST_CHUNK``, so a lone run does not count as its own repeat below
that.  Chunks are compared by 128-bit digest.

Runs of neighbouring repeated chunks are repeated passages if they have
``MIN_SPAN`` bytes and, with the chunk at either end that holds the passage's cut
end, more than ``MIN_WORDS`` words, so that passages of more words than that are
not passed over for their cut ends, and shorter repeats (license lines, headings)
stay.  Where words are not set apart every ``WORD_BYTES`` bytes count as one.  All
but the first occurrence (smallest id, then place) are removed.

Chunk digests first go through the fingerprint exchange of ``exact_dedup``; only
chunks that may repeat are written down, once, and shuffled with their places.
A digest that is very common is summed before its shuffle and met again by an
equi-join.  Of the texts with repeated chunks only those are looked at again whose
runs are long enough for a passage; they meet their runs in a shuffle.  The others
are passed on where they are read, if the former are few enough to be broadcast by
id (``BROADCAST_TEXTS``, counted), else they take part in the same join.

Defined cases: a null text is empty and has no chunks; rows equal in id and
text are one document and are treated alike; a null id comes last; a passage
that repeats within one text is removed from its later places; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.common import positional, stored
from quillmatch.llm.exact_dedup import MAX_FILTER_BITS, in_bitmap, suspect_test

WINDOW = 8
RADIUS = 16
MEAN_CHUNK = 2 * RADIUS + 1
LONGEST_CHUNK = 4096
MIN_SPAN = 64
MIN_WORDS = 50
WORD_BYTES = 24
SEED = 7

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) & 0xFFFF for b in range(256)], np.uint16)
_NEVER = np.uint16(0xFFFF)


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends of the chunks of one text's bytes, the last one its length."""
    return _chunks(data)[0]


def _chunks(data: bytes) -> tuple[np.ndarray, dict[int, int]]:
    """Ends of the chunks, and by end the number of those within a periodic run."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), {}
    rolled = _GEAR[raw]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[i - j] << j over the window, by doubling
        shifted = np.zeros_like(rolled)
        shifted[width:] = rolled[:-width] << np.uint16(width) if width < n else 0
        rolled = rolled + shifted
        width *= 2
    rolled[:-1][(raw[1:] & 0xC0) == 0x80] = _NEVER  # inside a character
    least, width = rolled.copy(), 1
    while width < RADIUS:  # least[i] = min of rolled[i - RADIUS + 1 : i + 1]
        least[width:] = np.minimum(least[width:], least[:-width])
        width *= 2
    cut = np.ones(n, bool)
    cut[1:] = rolled[1:] < least[:-1]
    cut[:-RADIUS] &= rolled[:-RADIUS] <= least[RADIUS:]
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    numbers: dict[int, int] = {}
    for k in np.flatnonzero(np.diff(ends, prepend=0) >= MIN_SPAN).tolist():
        start, end = int(ends[k - 1]) if k else 0, int(ends[k])
        # A run of MIN_SPAN bytes holds a whole block whose second half stands earlier in it too.
        if any(data.find(data[at + RADIUS : at + 2 * RADIUS], at) < at + RADIUS for at in range(start, end - 2 * RADIUS + 1, 2 * RADIUS)):
            _split_periods(start, end, raw, rolled, numbers)
    if numbers:
        ends = np.union1d(ends, np.fromiter(numbers, np.int64))
    if np.diff(ends, prepend=0).max() > LONGEST_CHUNK:
        ends = _split_long(ends, raw)
    return ends, numbers


def _split_periods(start: int, end: int, raw: np.ndarray, rolled: np.ndarray, numbers: dict[int, int]) -> None:
    """Cuts the longest periodic run between two ends into chunks of whole periods."""
    part = raw[start:end]
    best = (0, 0, 0)  # length, start, period
    for period in range(1, RADIUS + 1):
        edges = np.flatnonzero(np.concatenate(([True], part[period:] != part[:-period], [True])))
        gaps = np.diff(edges)
        k = int(gaps.argmax())
        best = max(best, (int(gaps[k]) - 1 + period, start + int(edges[k]), -period))
    length, first, period = best[0], best[1], -best[2]
    if length < MIN_SPAN:
        return
    at = first + WINDOW - 1
    at += int(rolled[at : at + period].argmin()) + 1  # the same turn of the period in every text
    size = period * -(-MEAN_CHUNK // period)
    numbers.setdefault(at, 0)
    for number, stop in enumerate(range(at + size, first + length + 1, size)):
        numbers[stop] = number % (LONGEST_CHUNK // size) + 1


def _split_long(ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Stretches without any boundary (such as one repeated letter) are cut by length."""
    out, start = [], 0
    for end in ends.tolist():
        while end - start > LONGEST_CHUNK:
            start += LONGEST_CHUNK
            while raw[start] & 0xC0 == 0x80:
                start -= 1
            out.append(start)
        out.append(end)
        start = end
    return np.array(out, np.int64)


def _digests(data: bytes, ends: np.ndarray, numbers: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of every chunk's digest."""
    digest, start, packed = xxhash.xxh3_128_digest, 0, []
    for end in ends.tolist():
        packed.append(digest(data[start:end], numbers.get(end, 0)))
        start = end
    halves = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _gathered(rows_at_once: int = 50_000):
    """Joins many small batches to fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows_at_once:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            data = _bytes(text.as_py())
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(_digests(data, *_chunks(data))[0])], names=["hash"])


_CHUNK = "id long, mark long, at int, size int, before int, after int, d1 long, d2 long"


def _suspects(slot_bits: int, shared):
    """A row for every chunk that may repeat: its place, the sizes of the chunks beside it, its digest."""
    names = _CHUNK.replace(",", "").split()[::2]

    def one(i: int | None, mark: int, data: bytes) -> pa.RecordBatch:
        ends, numbers = _chunks(data)
        d1, d2 = _digests(data, ends, numbers)
        may = in_bitmap(d1, slot_bits, shared.value)
        sizes = np.diff(ends, prepend=0)
        n, beside = int(may.sum()), np.concatenate([[0], sizes, [0]])
        ints = [pa.array(x[may].astype(np.int32)) for x in (ends - sizes, sizes, beside[:-2], beside[2:])]
        return pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(np.full(n, mark)), *ints, pa.array(d1[may]), pa.array(d2[may])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, mark, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                data = _bytes(text.as_py())
                if data:
                    yield one(i, mark, data)

    return lambda batches: _gathered()(run(batches))


def _runs(marks: list[tuple[int, ...]]) -> list[tuple[int, int, int, int]]:
    """Runs of touching chunks (at, size, before, after): start, end, and the reach with the chunks beside."""
    out: list[list[int]] = []
    for at, size, before, after in sorted(marks):
        if out and out[-1][1] >= at:
            if at + size >= out[-1][1]:
                out[-1][1], out[-1][3] = at + size, at + size + after
        else:
            out.append([at, at + size, at - before, at + size + after])
    return [tuple(x) for x in out]


def word_count(data: bytes) -> int:
    return sum(-(-len(w) // WORD_BYTES) for w in data.split())


def passages(data: bytes, marks: list[tuple[int, ...]], min_span: int, min_words: int) -> list[tuple[int, int]]:
    """The runs of repeated chunks that are long enough, in bytes."""
    return [(a, b) for a, b, low, high in _runs(marks) if b - a >= min_span and word_count(data[low:high]) > min_words]


def _may_hold_passage(min_span: int, min_words: int):
    """Keeps the rows whose last column, a text's repeated chunks, has a run long enough for a passage.

    More than ``min_words`` words are at least as many bytes and as many white spaces, less one.
    """
    least = 2 * (min_words + 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                any(b - a >= min_span and high - low >= least for a, b, low, high in _runs([(m["at"], m["size"], m["before"], m["after"]) for m in marks.as_py()]))
                for marks in batch.column(batch.num_columns - 1)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


#: Texts with long runs of repeated chunks whose ids are broadcast at most, about 120 bytes each in memory.
BROADCAST_TEXTS = 500_000
#: Rows whose spans a worker holds as objects at once.
ROWS_AT_ONCE = 256
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _points(data: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte spans as code points."""
    out, at, n = [], 0, 0
    for a, b in spans:
        n += len(data[at:a].decode("utf-8", "surrogatepass"))
        m = n + len(data[a:b].decode("utf-8", "surrogatepass"))
        out.append({"start": n, "end": m})
        at, n = b, m
    return out


def _cleared(text: str | None, marks: list[dict] | None, min_span: int, min_words: int) -> tuple[list, list, str]:
    """The repeated and the removed spans of a text, and what stays of it."""
    if not marks:
        return [], [], text or ""
    data = _bytes(text)
    repeated = passages(data, [(m["at"], m["size"], m["before"], m["after"]) for m in marks], min_span, min_words)
    later = [(a, b) for a, b, *_ in _runs([(m["at"], m["size"], 0, 0) for m in marks if not m["first"]]) if b - a >= min_span]
    removed = [(a, b) for a, b in later if any(x <= a and b <= y for x, y in repeated)]
    kept, at = [], 0
    for a, b in removed:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return _points(data, repeated), _points(data, removed), b"".join(kept).decode("utf-8", "surrogatepass")


def _apply(text_at: int, min_span: int, min_words: int):
    """Replaces the last column, a text's repeated chunks, by its spans and what stays."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                done = [_cleared(t.as_py(), m.as_py(), min_span, min_words) for t, m in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True)]
                new = [pa.array([d[k] for d in done], kind) for k, kind in enumerate((spans, spans, pa.string()))]
                columns = [*batch.columns[:-1], *new]
                yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN, min_words: int = MIN_WORDS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` with ``__repeated`` and ``__removed`` spans and ``__text``, the text without the latter."""
    own, (id_name, text_name) = positional(docs, id_col, text_col)
    text = F.col(text_name)
    size = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    hashes = own.select(text).mapInArrow(lambda batches: _gathered()(_hashes(batches)), "hash long")
    slot_bits, shared = suspect_test(hashes, size // MEAN_CHUNK + own.count(), max_filter_bits, 8)
    slim = own.select(F.col(id_name).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text)
    suspects = stored(slim.mapInArrow(_suspects(slot_bits, shared), _CHUNK))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "at")
    common = suspects.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("head")).filter("n > 1").drop("n")
    met = suspects.join(common, ["d1", "d2"]).withColumn("first", F.col("head") == place)
    marks = met.groupBy("id", "mark").agg(F.collect_set(F.struct("at", "size", "before", "after", "first")).alias("__marks"))
    marks = stored(marks.mapInArrow(_may_hold_passage(min_span, min_words), marks.schema))
    marks = marks.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__marks")
    same = F.col(id_name).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark"))
    new = [T.StructField("__repeated", _SPANS), T.StructField("__removed", _SPANS), T.StructField("__text", T.StringType())]
    schema = T.StructType([*own.schema.fields, *new])

    def cleared(met: DataFrame) -> DataFrame:
        return met.select(*own.columns, "__marks").mapInArrow(_apply(own.columns.index(text_name), min_span, min_words), schema)

    if marks.count() <= BROADCAST_TEXTS:
        ids = F.broadcast(marks.select("__id", "__mark"))
        none = F.array().cast(_SPANS)
        alone = own.join(ids, same, "left_anti").select(*own.columns, none.alias("__repeated"), none.alias("__removed"), F.coalesce(text, F.lit("")).alias("__text"))
        done = alone.unionByName(cleared(own.join(ids, same, "left_semi").join(marks, same)))
    else:
        done = cleared(own.join(marks, same, "left"))
    return done.toDF(*docs.columns, "__repeated", "__removed", "__text")
