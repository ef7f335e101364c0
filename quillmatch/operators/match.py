"""Matching of patterns against texts, and resolution of overlaps.

A text is tokenised once into an array.  Long ones are cut into windows, each
with the tokens that a match begun in it can reach.  Positions whose words
begin a pattern leave a window as small rows that hold only the tokens of the
longest pattern's span, never the text.  They meet the pattern table by an
equi-join on the words before a pattern's first wildcard, ``LEAD_WORDS`` of them
at most, so that a common first word does not meet all its patterns; the
catalogue's size is checked, and up to ``BROADCAST_WORDS`` words it is broadcast,
so no text and no token is shuffled.
The rest of a pattern is followed inside the row: a set of ends grows piece by
piece, so each end is kept once however many ways lead to it.  Only matches are
shuffled, by document, to resolve overlaps.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.functions.patterns import Pattern, collapsed
from quillmatch.functions.text import CHUNK_BYTES, tokens

PIECE = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("least", T.IntegerType()), T.StructField("most", T.IntegerType())])
PATTERNS = T.StructType([T.StructField("pattern_id", T.LongType()), T.StructField("lead", T.StringType()), T.StructField("pieces", T.ArrayType(PIECE))])
#: Words of a pattern's beginning that are joined on.
LEAD_WORDS = 4
#: Up to this many words are compared in the scan itself; more are looked up by checksum in a table of so many bytes at most.
WORDS_IN_SCAN, SLOTS = 200, 1 << 22
#: Words of all patterns together that are broadcast; beyond that the join is a shuffled one.
BROADCAST_WORDS = 2_000_000
#: Tokens of a text in which one row looks for beginnings.
WINDOW_TOKENS = 4096


class PatternSet:
    """The active patterns of one or more segments, less tombstones."""

    def __init__(self, segments: list[list[Pattern]], tombstones: frozenset[int] = frozenset(), generation: int = 0):
        # Equal sequences collapse inside a segment before tombstones act, so
        # that removing the winner does not bring back what it replaced.
        self.patterns = [p for s in segments for p in collapsed(s)]
        self.tombstones, self.generation = frozenset(tombstones), generation

    @classmethod
    def empty(cls) -> PatternSet:
        return cls([])

    @property
    def active(self) -> list[Pattern]:
        return [p for p in self.patterns if p.pattern_id not in self.tombstones]

    @property
    def longest_pattern(self) -> int:
        return max((len(p.tokens) for p in self.patterns), default=0)

    @property
    def longest_span(self) -> int:
        return max((p.span for p in self.patterns), default=0)

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (pattern_id, lead, pieces), marked for broadcast if they are few enough."""
        rows = [(p.pattern_id, " ".join(p.pieces[0].words[:LEAD_WORDS]), [(list(x.words), x.least, x.most) for x in p.pieces]) for p in self.active]
        table = spark.createDataFrame(rows, PATTERNS)
        return F.broadcast(table) if sum(len(p.tokens) for p in self.active) <= BROADCAST_WORDS else table

    def leads(self) -> dict[int, list[tuple[str, ...]]]:
        """The different beginnings of the patterns, by their number of words."""
        found: dict[int, set] = {}
        for p in self.active:
            lead = p.pieces[0].words[:LEAD_WORDS]
            found.setdefault(len(lead), set()).add(lead)
        return {n: sorted(found[n]) for n in sorted(found)}


def _among(value: Column, known: list[str]) -> Column:
    """False only for values that are not known; beyond ``WORDS_IN_SCAN`` a checksum's slot decides, and the join after it."""
    if len(known) <= WORDS_IN_SCAN:
        return value.isin(*known) if known else F.lit(False)
    slots = bytearray(min(SLOTS, 1 << (64 * len(known)).bit_length()))
    for x in known:
        slots[zlib.crc32(x.encode()) % len(slots)] = 1
    at = (F.crc32(F.encode(value, "UTF-8")) % len(slots) + 1).cast("int")
    return F.substring(F.lit(bytes(slots)), at, F.lit(1)) == F.lit(b"\1")


def _ends(toks: Column, start: Column, pieces: Column) -> Column:
    """All ends (exclusive) of a pattern that begins at ``start``, each once."""

    def grow(ends: Column, piece: Column) -> Column:
        n = F.size(piece["words"])

        def from_end(e: Column) -> Column:
            low, high = e + piece["least"], F.least(e + piece["most"], F.size(toks) - n)
            places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            fits = F.filter(places, lambda s: (F.element_at(toks, s + 1) == piece["words"][0]) & (F.slice(toks, s + 1, n) == piece["words"]))
            return F.transform(fits, lambda s: s + n)

        return F.array_distinct(F.flatten(F.transform(ends, from_end)))

    return F.aggregate(pieces, F.array(start), grow)


def raw_matches(docs: DataFrame, patterns: PatternSet, text: Column, *keep: str, mode: str = "file", chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """Rows (keep..., start, matched, pattern_id, start_line, end_line), not resolved.

    In files a line is read in chunks of ``chunk_bytes``, which end a word (None: whole).
    """
    spark = docs.sparkSession
    names = [f"`{k}`" for k in keep]
    tokenised = docs.select(*names, tokens(text, mode, chunk_bytes).alias("t")).select(*names, F.col("t.line").alias("__lines"), F.col("t.token").alias("__toks"))
    leads, span = patterns.leads(), max(1, patterns.longest_span)
    begins = F.sequence(F.lit(0), F.size("__toks") - 1, F.lit(WINDOW_TOKENS))
    # sequence(0, -1) would count down.
    begins = F.when(F.size("__toks") > 0, begins).otherwise(F.array().cast("array<int>"))

    def part(at: Column, n: int) -> list[Column]:
        return [F.slice("__toks", at + 1, n).alias("__toks"), F.slice("__lines", at + 1, n).alias("__lines")]

    cut = F.transform(begins, lambda b: F.struct(b.alias("__begin"), *part(b, WINDOW_TOKENS + span)))
    windows = tokenised.select(*names, F.explode(cut).alias("w")).select(*names, "w.*")
    places = F.sequence(F.lit(0), F.least(F.size("__toks"), F.lit(WINDOW_TOKENS)) - 1)

    def lead_at(i: Column, n: int) -> Column:
        # Fewer words where the text ends, which no beginning of n words equals.
        return F.concat_ws(" ", *(F.get(F.col("__toks"), i + k) for k in range(n)))

    def begun(n: int, known: list[tuple[str, ...]]) -> Column:
        at = F.filter(places, lambda i: _among(F.get(F.col("__toks"), i), sorted({x[0] for x in known})))
        if n > 1:
            at = F.filter(at, lambda i: _among(lead_at(i, n), [" ".join(x) for x in known]))
        return F.transform(at, lambda i: F.struct((F.col("__begin") + i).alias("start"), lead_at(i, n).alias("lead"), *part(i, span)))

    found = [begun(n, known) for n, known in leads.items()] or [begun(1, [])]
    hits = windows.select(*names, F.explode(F.concat(*found)).alias("h")).select(*names, "h.*")
    met = hits.join(patterns.table(spark), "lead")
    ended = met.select(*names, "pattern_id", "start", "__lines", F.explode(_ends(F.col("__toks"), F.lit(0), F.col("pieces"))).alias("matched"))
    return ended.select(
        *names,
        "start",
        "matched",
        "pattern_id",
        F.element_at("__lines", 1).alias("start_line"),
        F.element_at("__lines", F.col("matched")).alias("end_line"),
    )


def resolve(raw: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep..., ord, pattern_id, start_line, end_line): overlaps resolved.

    Longer matches win, then higher ids, then earlier starts; ``ord`` is that
    order.  Only matches of one island of overlaps decide about each other, so
    islands are folded, not documents.
    """
    by_doc = Window.partitionBy(*keep)
    seen = F.max(F.col("start") + F.col("matched")).over(by_doc.orderBy("start", F.col("matched").desc()).rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("start") >= F.col("__seen"), F.lit(True)), 1).otherwise(0)
    island = F.sum("__new").over(by_doc.orderBy("start", F.col("matched").desc()).rowsBetween(Window.unboundedPreceding, 0))
    marked = raw.withColumn("__seen", seen).withColumn("__new", begins).withColumn("__island", island)
    match = F.struct((-F.col("matched")).alias("m"), (-F.col("pattern_id")).alias("p"), "start", "start_line", "end_line")
    islands = marked.groupBy(*keep, "__island").agg(F.array_sort(F.collect_set(match)).alias("found"))

    def keep_free(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda y: (x["start"] < y["start"] - y["m"]) & (y["start"] < x["start"] - x["m"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("found", F.slice("found", 1, 0), keep_free)
    rows = islands.select(*keep, F.explode(kept).alias("x"))
    order = by_doc.orderBy("x.m", "x.p", "x.start")
    return rows.select(*keep, F.row_number().over(order).alias("ord"), (-F.col("x.p")).alias("pattern_id"), F.col("x.start_line").alias("start_line"), F.col("x.end_line").alias("end_line"))


def find_matches(docs: DataFrame, patterns: PatternSet, text: Column, *keep: str, mode: str = "file", chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """Resolved matches of every text."""
    return resolve(raw_matches(docs, patterns, text, *keep, mode=mode, chunk_bytes=chunk_bytes), *keep)
