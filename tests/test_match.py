"""Matching against a plain search, resolution against a plain greedy loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmatch.functions.patterns import Pattern, parse_patterns
from quillmatch.functions.text import tokens
from quillmatch.operators import match


def found(spark, patterns, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = match.find_matches(docs, match.PatternSet([parse_patterns(patterns)]), F.col("text"), "doc_id", **options).orderBy("ord").collect()
    return [(r.pattern_id, r.start_line, r.end_line) for r in rows]


@pytest.mark.parametrize(
    "patterns, text, expected",
    [
        ([(10, "alpha bravo charlie"), (11, "bravo charlie"), (12, "charlie delta")], "alpha bravo charlie delta", [(10, 1, 1)]),
        ([(30, "alpha bravo"), (31, "charlie delta")], "alpha bravo charlie delta", [(31, 1, 1), (30, 1, 1)]),
        ([(20, "u v w x y"), (21, "golf hotel")], "u v w x y golf hotel", [(20, 1, 1), (21, 1, 1)]),
        ([(1, "copyleft")], "it is copyleft", [(1, 1, 1)]),
        ([(1, "alpha $SKIP99 omega")], "alpha\n" + "x\n" * 50 + "omega", [(1, 1, 52)]),
        ([(1, "tok")], "x\0tok\ntok", [(1, 2, 2)]),
        ([], "anything", []),
        ([(1, "x y")], "", []),
    ],
)
def test_cases(spark, patterns, text, expected):
    assert found(spark, patterns, text) == expected


@pytest.mark.parametrize("gap, n", [(0, 0), (1, 1), (2, 1), (3, 0)])
def test_wildcard_width(spark, gap, n):
    assert len(found(spark, [(1, "hello $SKIP2 world")], "hello " + "w " * gap + "world")) == n


def test_many_matches_stay_in_order(spark):
    got = found(spark, [(1, "permission is hereby granted")], "permission is hereby granted\n" * 2000)
    assert got == [(1, i, i) for i in range(1, 2001)]


def test_wildcard_fan_out_ends(spark):
    got = found(spark, [(1, "xx $SKIP99 xx $SKIP99 xx $SKIP99 xx $SKIP99 xx")], "xx " * 451)
    assert got[0] == (1, 1, 1)


def plain_ends(toks, start, pieces):
    ends = {start}
    for p in pieces:
        ends = {s + len(p.words) for e in ends for s in range(e + p.least, e + p.most + 1) if tuple(toks[s : s + len(p.words)]) == p.words}
    return ends


def test_random_streams_against_plain_search(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["x", "y", "z\n"]) for _ in range(rng.randrange(0, 25))) for _ in range(40)]
    patterns = []
    for i in range(1, 25):
        words = [rng.choice("xyz") for _ in range(rng.randrange(1, 4))]
        if len(words) > 1 and rng.random() < 0.6:
            words.insert(1, f"$SKIP{rng.randrange(1, 4)}")
        patterns.append((i, " ".join(words)))
    active = match.PatternSet([parse_patterns(patterns)], frozenset({3}))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    toks = {r.doc_id: r.t for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect()}
    raw = set()
    for doc_id, ts in toks.items():
        words = [t.token for t in ts]
        for p in active.active:
            for s in range(len(words)):
                raw |= {(doc_id, s, e - s, p.pattern_id, ts[s].line, ts[e - 1].line) for e in plain_ends(words, s, p.pieces) if e > s}
    got = {tuple(r) for r in match.raw_matches(docs, active, F.col("text"), "doc_id").collect()}
    assert got == raw
    expected = {}
    for doc_id in toks:
        kept = []
        for m in sorted((m for m in raw if m[0] == doc_id), key=lambda m: (-m[2], -m[3], m[1])):
            if all(m[1] + m[2] <= k[1] or k[1] + k[2] <= m[1] for k in kept):
                kept.append(m)
        expected[doc_id] = [(m[3], m[4], m[5]) for m in kept]
    rows = match.find_matches(docs, active, F.col("text"), "doc_id").orderBy("doc_id", "ord").collect()
    best = {}
    for r in rows:
        best.setdefault(r.doc_id, []).append((r.pattern_id, r.start_line, r.end_line))
    assert best == {k: v for k, v in expected.items() if v}


def test_no_text_is_shuffled_or_broadcast(spark):
    docs = spark.createDataFrame([(i, "licensed under the gnu license " * 3) for i in range(40)], "doc_id int, text string").repartition(6)
    docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
    patterns = match.PatternSet([parse_patterns([(1, "licensed under"), (2, "gnu $SKIP3 license")])])
    found = match.raw_matches(docs, patterns, F.col("text"), "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert re.findall(r"BroadcastHashJoin .*, (Build\w+)", plan) == ["BuildRight"]
    assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*__toks", plan)


def test_texts_longer_than_a_window(spark, monkeypatch):
    monkeypatch.setattr(match, "WINDOW_TOKENS", 8)
    text = "one two three four five six seven\n" * 30
    patterns = [(1, "six seven one two"), (2, "seven $SKIP9 seven"), (3, "one $SKIP20 four $SKIP9 two"), (4, "five")]
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    small = sorted(map(tuple, match.raw_matches(docs, match.PatternSet([parse_patterns(patterns)]), F.col("text"), "doc_id").collect()))
    monkeypatch.setattr(match, "WINDOW_TOKENS", 4096)
    whole = sorted(map(tuple, match.raw_matches(docs, match.PatternSet([parse_patterns(patterns)]), F.col("text"), "doc_id").collect()))
    assert small == whole and len(whole) > 100


def test_long_lines_are_read_in_chunks(spark):
    text = "x" * 7990 + " alpha bravo\n" + "y " * 3990 + "alpha bravo"
    for chunk, expected in ((match.CHUNK_BYTES, [(1, 2, 2)]), (None, [(1, 2, 2), (1, 1, 1)])):
        assert sorted(found(spark, [(1, "alpha bravo")], text, chunk_bytes=chunk)) == sorted(expected)


def test_thousands_of_patterns_in_a_long_file(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    patterns = [(i, f"{rng.choice(vocab)} {rng.choice(vocab)} $SKIP{rng.randrange(1, 30)} {rng.choice(vocab)}") for i in range(1, 5001)]
    words = [rng.choice(vocab) for _ in range(230_000)]
    docs = spark.createDataFrame([(1, "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)))], "doc_id int, text string")
    active = match.PatternSet([parse_patterns(patterns)])
    got = {(r.start, r.matched, r.pattern_id) for r in match.raw_matches(docs, active, F.col("text"), "doc_id").collect()}
    begins = {}
    for i in range(len(words) - 1):
        begins.setdefault((words[i], words[i + 1]), []).append(i)
    expected = set()
    for p in {p.tokens: p for p in active.active}.values():
        for i in begins.get(p.tokens[:2], []):
            expected |= {(i, e + 1 - i, p.pattern_id) for e in range(i + 3, min(i + 3 + p.tokens[2], len(words))) if words[e] == p.tokens[3]}
    assert got == expected and len(got) > 200


def test_segments_collapse_before_tombstones():
    one = [Pattern.of(1, ["x"]), Pattern.of(2, ["x"])]
    assert [p.pattern_id for p in match.PatternSet([one]).active] == [2]
    assert match.PatternSet([one], frozenset({2})).active == []
    assert len(match.PatternSet([one[:1], one[1:]]).active) == 2


def test_common_first_words_do_not_meet_all_their_patterns(spark):
    """Thousands of patterns with one first word: a position meets those that go on like the text."""
    patterns = [Pattern.of(i + 1, ["the", f"w{i // 50}", f"v{i}", 2, "end"]) for i in range(3000)] + [Pattern.of(4000, ["the", "end"]), Pattern.of(4001, ["the"])]
    text = "the w3 v151 x y end the w3 v9 end the w59 v2999 x end the"
    docs = spark.createDataFrame([(1, text), (2, "the end the w3"), (3, ""), (4, None)], "doc_id int, text string")
    active = match.PatternSet([patterns])
    expected = [(1, 0, 6, 152), (1, 10, 5, 3000), (2, 0, 2, 4000), *((1, s, 1, 4001) for s in (0, 6, 10, 15)), (2, 0, 1, 4001), (2, 2, 1, 4001)]
    assert sorted((r.doc_id, r.start, r.matched, r.pattern_id) for r in match.raw_matches(docs, active, F.col("text"), "doc_id").collect()) == sorted(expected)
    table = active.table(spark)
    assert max(r["count"] for r in table.groupBy(next(c for c in table.columns if c not in ("pattern_id", "pieces"))).count().collect()) == 1
