"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmatch.llm import exact_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, kept string, __copy string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_rice_code_round_trip():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 20), (1, 60), (500, 12), (5000, 61)):
        values = np.unique(rng.integers(0, 2**bits, n, dtype=np.uint64))
        width, unary, rests = exact_dedup.rice_encode(values, bits)
        assert np.array_equal(exact_dedup.rice_decode(len(values), width, unary, rests), values)


ROWS = [(1, "same"), (2, "same"), (3, "other"), (4, None), (5, ""), (6, "Same"), (6, "same"), (6, "same"), (None, "lone"), (None, "lone"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "é")]


def test_exact_duplicates(spark):
    rows = ROWS + [(100 + i, f"text {i % 60}") for i in range(90)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_duplicates(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for t, ids in groups.items():
        found = by[hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in found)
        assert all(r.keep_id == best and r.group_size == len(ids) for r in found)
        assert [r.doc_id for r in found if r.kept] == [best]


def test_exact_duplicates_by_many_senders_and_owners(spark, monkeypatch):
    """Senders of three rows and owners of eight hashes answer as large ones do; a unique row is no suspect."""
    rows = ROWS + [(100 + i, f"text {i % 60}") for i in range(90)]
    whole = sorted(map(str, exact_dedup.exact_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "OWNER_HASHES", 8)
    for parts in (1, 7):
        df = frame(spark, rows).repartition(parts)
        assert sorted(map(str, exact_dedup.exact_duplicates(df).collect())) == whole
        text = F.coalesce("text", F.lit(""))
        marked = exact_dedup.exchanged(df.select(F.col("doc_id").alias("id"), *exact_dedup._keys(text))).collect()
        count = {}
        for _, t in rows:
            sha = hashlib.sha256((t or "").encode()).hexdigest()
            count[sha] = count.get(sha, 0) + 1
        assert len(marked) == len(rows) and all(r.suspect == (count[r.sha] > 1) for r in marked)


def test_suspect_test_never_misses_a_repeat(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, 500)
    df = spark.createDataFrame([(int(v),) for v in [*values, *values[:40]]], "hash long").repartition(4)
    for bits in (5, 30):
        slot_bits, shared = exact_dedup.suspect_test(df, 540, bits)
        assert exact_dedup.in_bitmap(values[:40], slot_bits, shared.value).all()
    assert exact_dedup.in_bitmap(values[40:], slot_bits, shared.value).mean() < 0.1


def test_drop_exact_duplicates_keeps_columns(spark):
    df = frame(spark, ROWS)
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("6", "same"), ("3", "other"), ("5", ""), ("6", "Same"), ("None", "lone"), ("8", "x" * 200_000), ("9", "é")])


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(3)
    texts = [None, "", " \t", "One", "A b  C", "ÀB c d e", "x y z\x1cw v"] + [" ".join(rng.choice("ab cd E é".split()) for _ in range(n)) for n in (4, 5, 50, 198, 203, 400)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def components(ids, prints, bits):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        k = find(i)
        least[k] = min(least.get(k, d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def near(rng, n):
    """Random fingerprints with chains and clusters of close ones."""
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_links_find_every_component(spark):
    rng = random.Random(8)
    prints = near(rng, 600)
    ids = list(range(len(prints)))
    rng.shuffle(ids)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks)
        pairs = [(a, b) for a in range(80) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
        assert all(any((signed[a] & m) == (signed[b] & m) for m in masks) for a, b in pairs)
    got = {r.doc_id: r.component_id for r in df.join(simhash._groups(df, 4), "fp").collect()}
    assert got == components(ids, prints, 4)


def test_big_buckets_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    rng = random.Random(5)
    base = rng.getrandbits(62)
    prints = sorted({base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(40)) for _ in range(300)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash._groups(df, 4), "fp").collect()}
    assert got == components(list(range(len(prints))), prints, 4)


def test_star_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_drop_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    close = " ".join(words[:399] + ["other"])
    rows = [(5, " ".join(words)), (3, close), (9, "alone"), (4, None), (2, ""), (8, "alone"), (8, "alone"), (None, "alone")]
    df = frame(spark, rows)
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in got.collect())
    assert [d for d, _ in kept] == [2, 3, 8]
    report = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert report == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 8), (4, 2), (2, 2)}


def plain_repeats(texts, width):
    """Which code points of each text lie in a window that occurs elsewhere too."""
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - width + 1):
            seen.setdefault(t[i : i + width], []).append((d, i))
    out = {d: set() for d in texts}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d].update(range(i, i + width))
    return out


def test_repeated_passages_are_found_and_removed(spark):
    rng = random.Random(21)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passage, other = words(70), words(90)
    texts = {i: words(rng.randrange(60, 120)) for i in range(40)}
    for i in (3, 9, 17, 30):
        texts[i] = words(20 + i) + " " + passage + " " + words(30)
    for i in (5, 30):
        texts[i] = texts[i] + other + words(3)
    texts[33] = texts[34]
    df = frame(spark, [*texts.items(), (90, None), (91, ""), (92, "é" * 20_000), (93, "é" * 20_000)])
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(df).collect()}
    assert len(got) == len(texts) + 4
    flagged = {d for d, r in got.items() if r["__repeated"]}
    assert flagged == {3, 9, 17, 30, 5, 33, 34, 92, 93}
    truth = plain_repeats(texts, 20)
    for d in texts:
        r = got[d]
        spans = {i for s in r["__repeated"] for i in range(s.start, s.end)}
        assert spans <= truth[d]
        if d in (9, 17, 30):
            assert passage[60:-60] not in r["__text"] and len(r["__text"]) < len(texts[d])
    assert passage in got[3]["__text"] and got[33]["__text"] == texts[33] and got[34]["__text"] == ""
    assert got[0]["__text"] == texts[0] and got[90]["__text"] == "" and got[93]["__text"] == ""


def test_chunks_resist_insertions():
    rng = random.Random(2)
    data = "".join(rng.choice("abcdefgh éß") for _ in range(20_000)).encode()
    ends = substring_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and np.all(np.diff(ends, prepend=0) > 0)
    for e in ends:
        data[:e].decode()
    moved = set(substring_dedup.chunk_ends(data[:5000] + b"inserted" + data[5000:]).tolist())
    after = [e for e in ends.tolist() if e > 5000 + substring_dedup.WINDOW + substring_dedup.RADIUS]
    assert all(e + 8 in moved for e in after)
    assert np.diff(substring_dedup.chunk_ends(b"a" * 50_000), prepend=0).max() <= substring_dedup.LONGEST_CHUNK


def test_extra_columns_with_clashing_names(spark):
    df = frame(spark, [(1, "a b c d e"), (2, "a b c d e")]).withColumn("n", F.lit(1)).withColumn("fp", F.lit("z")).withColumn("id", F.lit("q")).withColumn("mark", F.lit(0)).withColumn("hash", F.lit(2)).withColumn("repeated", F.lit(2))
    for name in ("__sha", "__suspect", "__keep", "__r", "__mark", "__id", "__text", "__done"):
        df = df.withColumn(name, F.lit(1))
    assert exact_dedup.drop_exact_duplicates(df).columns == df.columns
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [1]
    assert substring_dedup.dedup_substrings(df).count() == 2


def test_passages_by_either_join(spark, monkeypatch):
    """Texts with long runs give the same rows whether their ids are broadcast or all texts are joined, and none is lost before."""
    rng = random.Random(9)
    words = [" ".join("".join(rng.choice("bcdfgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)) for n in (70, 56, 20, 90)]
    rows = [(i, " ".join([rng.choice(words), f"own {i} " * rng.randrange(3), rng.choice(words), str(i)])) for i in range(40)]
    df = frame(spark, [*rows, (50, None), (51, ""), (None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1])])

    def found():
        return sorted((str(r.doc_id), str(r["__repeated"]), str(r["__removed"]), r["__text"]) for r in substring_dedup.dedup_substrings(df).collect())

    by_ids = found()
    monkeypatch.setattr(substring_dedup, "BROADCAST_TEXTS", -1)
    by_join = found()
    monkeypatch.setattr(substring_dedup, "_may_hold_passage", lambda *_: lambda batches: batches)
    assert len(by_ids) == 45 and by_ids == by_join == found()
    assert any(r[1] != "[]" for r in by_ids) and any(r[1] == "[]" for r in by_ids)
