"""Normalisation of text into word tokens, as native column expressions.

Every character but printable ASCII (0x21 to 0x7F) is a blank and letters are
lower case.  Words are what the separators leave; one trailing dot and leading
``+``, ``-`` and ``/`` go, words without a letter or digit and stop words are
dropped.  Lines end at a line feed only.  In files a NUL hides the rest of its
line (or chunk); in strings it ends the text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = ("dnl", "rem", "br", "p", "c", "cc", "a", "n", "r")
SEPARATORS = r"[ *;,:!#{}()\[\]|></\\?\"'`=]+"
#: Bytes of a long line that file readers take at once.
CHUNK_BYTES = 7998


def clean(line: Column) -> Column:
    """A line with blanks for all but printable ASCII, in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\x21-\x7f]", " "))


def words(line: Column) -> Column:
    """The kept words of one line, in order."""
    parts = F.split(clean(line), SEPARATORS)
    bare = F.transform(parts, lambda t: F.ltrim(F.when(F.endswith(t, F.lit(".")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t), F.lit("+-/")))
    return F.filter(bare, lambda t: t.rlike("[a-z0-9]") & ~t.isin(*STOP_WORDS))


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def chunks(line: Column, size: int = CHUNK_BYTES) -> Column:
    """A line cut after every ``size`` bytes; lines of ASCII that are short stay one."""
    raw = F.encode(line, "UTF-8")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(raw) - 1, F.lit(0)), F.lit(size))
    # Bytes of a cut character are blanks on both sides, as all beyond ASCII.
    cut = F.transform(starts, lambda s: F.decode(F.substring(raw, s + 1, F.lit(size)), "ISO-8859-1"))
    return F.when(F.octet_length(line) <= size, F.array(line)).otherwise(cut)


def tokens(text: Column, mode: str = "string", chunk_bytes: int | None = None) -> Column:
    """Array of (line, token) of a whole text, lines from 1; null for a null text.

    mode "string": a NUL ends the text.  mode "file": a NUL ends its line, or
    its chunk where ``chunk_bytes`` cuts long lines as a buffered reader does.
    """
    whole = until_nul(text) if mode == "string" else text

    def of_line(line: Column, at: Column) -> Column:
        number = (at + 1).cast("int")
        if mode == "string":
            found = words(line)
        elif chunk_bytes:
            found = F.flatten(F.transform(chunks(line, chunk_bytes), lambda x: words(until_nul(x))))
        else:
            found = words(until_nul(line))
        return F.transform(found, lambda t: F.struct(number.alias("line"), t.alias("token")))

    return F.flatten(F.transform(F.split(whole, "\n"), of_line))


#: Blanks for separators and all bytes but printable ASCII, small letters; line feeds stay.
_PLAIN = bytes(c if c == 10 else 32 if not 33 <= c <= 127 or re.fullmatch(SEPARATORS, chr(c)) else ord(chr(c).lower()) for c in range(256))
#: Different words whose form is remembered.
KNOWN_WORDS = 200_000


class Words(dict):
    """Kept forms of words as bytes, empty for those that are dropped: the rules of ``tokens`` inside an Arrow worker."""

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        bare = (raw[:-1] if raw.endswith(b".") else raw).lstrip(b"+-/")
        self[raw] = bare if re.search(b"[a-z0-9]", bare) and bare.decode() not in STOP_WORDS else b""
        return self[raw]

    def of_file(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """The words of a UTF-8 text in mode "file", lines whole, and the line of each."""
        if b"\0" in text:
            text = b"\n".join(line.partition(b"\0")[0] for line in text.split(b"\n"))
        found, counts = [], []
        for line in text.translate(_PLAIN).split(b"\n"):
            kept = [t for t in map(self.__getitem__, line.split()) if t]
            found += kept
            counts.append(len(kept))
        return found, np.repeat(np.arange(1, len(counts) + 1), counts)


def pattern_tokens(text: Column) -> Column:
    """Words of a whole string as one buffer, as patterns are read."""
    return words(until_nul(text))


def token_rows(docs: DataFrame, text: Column, *keep: str, mode: str = "file", chunk_bytes: int | None = None) -> DataFrame:
    """One row per token: the columns ``keep``, ``pos`` from 0, ``line`` and ``token``."""
    exploded = docs.select(*keep, F.posexplode(tokens(text, mode, chunk_bytes)).alias("pos", "t"))
    return exploded.select(*keep, "pos", F.col("t.line").alias("line"), F.col("t.token").alias("token"))


def lines(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """One row per physical line, numbered from 1."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "text")).select(*keep, (F.col("at") + 1).alias("line"), "text")


def spread(docs: DataFrame, key: str) -> DataFrame:
    """Deals rows by key where the scan has fewer partitions than shuffles get.

    A single row group would otherwise be tokenised by one task.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(width, key) if docs.rdd.getNumPartitions() < width else docs
