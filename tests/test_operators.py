"""Lines, tf-idf, distance, fingerprints and content hashes."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillmatch.functions.patterns import words
from quillmatch.functions.spooky import hash64_of_tokens
from quillmatch.functions.text import tokens
from quillmatch.operators import bag, distance, fingerprint, lines


def test_read_lines(spark):
    docs = spark.createDataFrame([(1, "x\ny\nla araña"), (2, "only")], "doc_id int, text string")
    wanted = spark.createDataFrame([(1, 3, 42), (1, 1, 7), (1, 99, 1), (3, 1, 1)], "doc_id int, line int, value long")
    got = lines.read_lines(docs, F.col("text"), wanted).orderBy("line").collect()
    assert [(r.doc_id, r.line, r.value, bytes(r.text)) for r in got] == [(1, 1, 7, b"x"), (1, 3, 42, "la araña".encode())]
    cut = lines.read_lines(docs, F.col("text"), wanted, line_bytes=2).orderBy("line").collect()
    assert bytes(cut[1].text) == b"la"


def test_best_for_against_plain_loops(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("red green blue gray pink teal".split()) for _ in range(rng.randrange(0, 6))) for i in range(1, 9)}
    queries = {i: " ".join(rng.choice("red green blue other".split()) for _ in range(rng.randrange(0, 5))) for i in range(6)}
    df = {}
    for t in texts.values():
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(texts) / n) for w, n in df.items()}

    def vector(t):
        return {w: idf[w] for w in set(words(t)) if w in idf}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    expected = {}
    for q, t in queries.items():
        own, scores = vector(t), []
        for i, p in texts.items():
            v = vector(p)
            dot = sum(x * v[w] for w, x in own.items() if w in v)
            scores.append((-round(dot / norm(v) / norm(own), 9) if norm(v) and norm(own) else 0.0, i))
        expected[q] = [(i, math.floor(-s * 10000 + 1e-7) / 10000) for s, i in sorted(scores)[:3]]
    p = spark.createDataFrame(list(texts.items()), "pattern_id int, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id int, body string")
    got = {}
    for r in bag.best_for(q, F.col("body"), p, F.col("text"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.pattern_id, r.match))
    assert got == expected
    assert bag.best_for(q, F.col("body"), p, F.col("text"), 0).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance(spark):
    rng = random.Random(9)
    pairs = [([rng.choice("xyz") for _ in range(rng.randrange(12))], [rng.choice("xyz") for _ in range(rng.randrange(12))]) for _ in range(150)] + [(None, ["x", "y"])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in df.select("i", distance.token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: plain_distance((a or [])[:-1], (b or [])[:-1]) for i, (a, b) in enumerate(pairs)}


def plain_winnow(grams, w):
    out = []
    for i in range(len(grams) - w + 1):
        best = min(range(i, i + w), key=lambda p: (grams[p], -p))
        if not out or out[-1] != best:
            out.append(best)
    return out


def test_winnow_and_grams():
    rng = np.random.default_rng(3)
    for n in (0, 3, 4, 5, 60):
        grams = rng.integers(0, 6, n).astype(np.uint64) << np.uint64(61)
        assert fingerprint.winnow(grams, 4).tolist() == sorted(set(plain_winnow(grams.tolist(), 4)))
    hashes = hash64_of_tokens(["x", "y", "z"])
    h = fingerprint.BASIS
    for t in hashes[:2]:
        h = ((h ^ int(t)) * fingerprint.PRIME) % 2**64
    assert int(fingerprint.gram_hashes(hashes, 2)[0]) == h


def test_fingerprints_of_rows(spark):
    text = "\n".join(f"w{i} v{i * 7 % 13}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "two words"), (3, ""), (4, None), (5, text)], "doc_id long, text string")
    rows = fingerprint.fingerprints(docs, F.col("text"), "doc_id", 3, 4).collect()
    by = {d: sorted((r.pos, r.fp, r.start_line, r.end_line) for r in rows if r.doc_id == d) for d in range(1, 6)}
    toks = words(text)
    grams = fingerprint.gram_hashes(hash64_of_tokens(toks), 3)
    assert [r[0] for r in by[1]] == plain_winnow(grams.tolist(), 4)
    assert by[1] == by[5] and not by[2] and not by[3] and not by[4]
    assert all(r[2] == r[0] // 2 + 1 and r[3] == (r[0] + 2) // 2 + 1 for r in by[1])


def test_winnow_rows_of_texts_where_they_are_read(spark):
    """Against plain loops over the column expressions' words, without a shuffle."""
    rng = random.Random(6)
    parts = ["The", "a", "x.", "-y", "b+c", "++", "é", "\u4e16w", "Rem", "\t", "\0", "z\x7f", "..", "(v)", "\n", "'"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(30)] + ["", None, "same word " * 30, "\n\na.b\r\n" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = fingerprint.winnow_rows(docs, F.col("text"), "doc_id", 3, 4)
    expected = set()
    for r in docs.select("doc_id", tokens(F.col("text"), "file").alias("t")).collect():
        toks = r.t or []
        grams = [hashlib.md5(" ".join(t.token for t in toks[i : i + 3]).encode()).hexdigest() for i in range(len(toks) - 2)]
        expected |= {(r.doc_id, p, grams[p], toks[p].line, toks[p + 2].line) for p in plain_winnow(grams, 4)}
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_content_hash(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 500)], "doc_id int, text string")
    got = {r.doc_id: r.content_hash for r in fingerprint.content_hash(docs, F.col("text"), "doc_id").collect()}
    assert got[1] == "0" * 32 and got[2] != got[1] and len(got[3]) == 32


def test_containment(spark):
    prints = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 9)], "doc_id int, fp long")
    got = {(r.a, r.b): r.containment for r in fingerprint.containment(prints, least=0.6).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 2 / 3}
