"""Normalisation, patterns and hashes against known values and plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.functions import patterns as P
from quillmatch.functions import text as T
from quillmatch.functions.spooky import Hash, hash64_of_tokens, hash128, hex128


def rows(spark, text, **options):
    got = spark.createDataFrame([(text,)], "text string").select(T.tokens(F.col("text"), **options).alias("t")).first().t
    return [(r.line, r.token) for r in got]


def test_words_and_lines(spark):
    assert rows(spark, "Hello\nWorld") == [(1, "hello"), (2, "world")]
    assert rows(spark, "") == []
    assert rows(spark, " *;,: ") == []
    assert rows(spark, "dnl C++ ++x --- a.b. ... N/A") == [(1, "c++"), (1, "x"), (1, "a.b")]
    assert rows(spark, "böses Kelvin") == [(1, "b"), (1, "ses"), (1, "elvin")]
    assert rows(spark, "x\r\ny\n\nz") == [(1, "x"), (2, "y"), (4, "z")]


def test_nul_ends_text_or_line(spark):
    assert rows(spark, "one\0two\nthree", mode="string") == [(1, "one")]
    assert rows(spark, "one\0two\nthree", mode="file") == [(1, "one"), (2, "three")]


def test_chunks_cut_long_lines(spark):
    assert rows(spark, "abcdef ghi", mode="file", chunk_bytes=4) == [(1, "abcd"), (1, "ef"), (1, "g"), (1, "hi")]
    assert rows(spark, "abc\0ef gh", mode="file", chunk_bytes=5) == [(1, "abc"), (1, "f"), (1, "gh")]


def test_column_and_driver_words_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abN rc.+-/*;$'\"= \n\0é9") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.w for r in df.select("i", T.pattern_tokens(F.col("text").alias("x")).alias("w")).collect()}
    assert all(got[i] == P.words(t.replace("\n", " ")) for i, t in enumerate(texts))


def test_pattern_parsing():
    assert P.parse_tokens("$SKIP5 hello world") == ["hello", "world"]
    assert P.parse_tokens("hello world $SKIP5") == ["hello", "world"]
    assert P.parse_tokens("hello $SKIP5 world") == ["hello", 5, "world"]
    assert P.parse_tokens("hello $SKIP500 world") == ["hello", "$skip500", "world"]
    assert P.parse_tokens("x $SKIP y $SKIP0 z $SKIP100") == ["x", "$skip", "y", "$skip0", "z", "$skip100"]
    assert P.parse_tokens("x $SKIP05 y $SKIP+5 z") == ["x", 5, "y", 5, "z"]
    with pytest.raises(ValueError):
        P.Pattern.of(1, P.parse_tokens("hello $SKIP5 $SKIP6"))
    for bad in (0, 2**32, -1, True):
        with pytest.raises(ValueError):
            P.checked_id(bad)
    pieces = P.Pattern.of(7, ["x", 2, 3, "y", "z"]).pieces
    assert [(p.words, p.least, p.most) for p in pieces] == [(("x",), 0, 0), (("y", "z"), 2, 5)]
    assert P.Pattern.of(7, ["x", 2, 3, "y", "z"]).span == 8


def test_hash_known_values():
    assert hash64_of_tokens(["hello", "world"]).tolist() == [11695443286496022098, 14227499413149678217]
    h = Hash(0, 0).add("Hállöchen\n").add("abc̀")
    assert h.hex() == "d6d58320114a2d3c1d6dd671ab0383ec"
    assert h.hash64() == 15480423467908214076


def test_hash_groups_agree_with_single_messages():
    rng = random.Random(2)
    tokens = ["".join(rng.choice("abcdefé") for _ in range(n)) for n in range(230)]
    assert [int(x) for x in hash64_of_tokens(tokens)] == [hash128(t.encode(), 1, 1)[0] for t in tokens]
    assert re.fullmatch("[0-9a-f]{32}", hex128(hash128(b"x" * 1000)))
    assert np.unique([hash128(b"x" * n)[0] for n in range(400)]).size == 400
