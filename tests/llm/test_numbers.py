"""Mixing, top-k search and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmatch.llm import bpe, mixing, simhash, topk
from quillmatch.llm.queries import word_bpe_path


def plain_targets(words, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, budget, out = set(order), share * sum(words.values()), {}
    while free:
        level = budget / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > most * words[s]}
        if not above:
            return out | {s: w[s] * level for s in free}
        for s in above:
            out[s] = most * words[s]
            budget -= out[s]
        free -= above
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(900)]
    return rows + [(900, None, "a"), (901, " \t", "b"), (902, "x " * 5000, "c")] + [(903, "same same", "d")] * 40


def test_mix_plan(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(corpus)
    words, largest = {}, {}
    for _, t, s in corpus:
        n = len((t or "").split())
        words[s] = words.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    goal, taken = plain_targets(words), {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == words[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert sum(goal.values()) == pytest.approx(1.5 * sum(words.values()))
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in goal)
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_rows_take_what_the_plan_says(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("__q", F.lit(1)).withColumn("__source", F.lit(1)).withColumn("__copies", F.lit(1))
    plan = {}
    for r in mixing.mix_plan(df).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
    rows = mixing.mix_rows(df)
    assert rows.columns == df.columns
    taken = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert taken == {d: n for d, n in plan.items() if n}


def plain_copies(sizes, target, most=2):
    """Expected copies in proportion to the bits of a size, up to ``most``, that give the target: by bisection."""
    low, high = 0.0, 2.0 * most
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most, level * n.bit_length()) * n for n in sizes) < target:
            low = level
        else:
            high = level
    return [min(most, low * n.bit_length()) for n in sizes]


def test_inclusion_rates_are_those_of_each_document(spark):
    """The same forty documents in 300 sources: ids differ, so do the random odds."""
    rng = random.Random(9)
    sizes = [rng.choice([1, 2, 3, 5, 9, 17, 33, 60, 90]) for _ in range(40)]
    rows = [(1000 * s + k, "w " * n, f"s{s:03d}") for s in range(300) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.4, 1.5):
        taken = [0] * len(sizes)
        for r in mixing.mix_plan(df, weights=(1.0,), budget_share=share).select("doc_id", "copies").collect():
            taken[r.doc_id % 1000] += r.copies
        wanted = plain_copies(sizes, share * sum(sizes))
        rates = [n / 300 for n in taken]
        assert max(abs(a - b) for a, b in zip(rates, wanted, strict=True)) < 0.12
        for n in set(sizes):
            own = [k for k, m in enumerate(sizes) if m == n]
            assert sum(rates[k] for k in own) / len(own) == pytest.approx(wanted[own[0]], abs=0.05)
        assert max(wanted) - min(wanted) > 0.3


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(df).count() == 0 and mixing.mix_rows(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.mix_plan(blank).collect()] == [(0, 0.0, 0)] * 2


def test_source_ranks(spark):
    names = [f"s{i:03d}" for i in range(50)] + ["é", "Z", None]
    got = {r.source: r["rank"] for r in mixing.source_ranks(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def plain_top_k(rows, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int).tolist()) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    least = {}
    for i, v in good:
        least[i] = min(v, least.get(i, v))
    out = []
    for i, q in least.items():
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(25)] + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6), (405, [2.0, 3.0]), (410, [1e6] * 8)]
    rows += [(20, rows[5][1]), (20, rows[6][1]), (33, rows[9][1]), (33, rows[9][1]), (420, [-3.0]), (430, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("salt", F.lit(1))
    for k, block, queries, held, bounds in ((10, 4096, 1024, 32, 1 << 20), (10, 16, 5, 32, 1 << 20), (10, 16, 5, 2, 40), (1, 7, 3, 32, 1 << 20), (1000, 64, 5, 3, 100)):
        for name, value in (("BLOCK_ROWS", block), ("QUERY_ROWS", queries), ("HELD_BLOCKS", held), ("HELD_BOUNDS", bounds)):
            monkeypatch.setattr(topk, name, value)
        got = sorted(map(tuple, topk.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, k).collect()))
        assert got == plain_top_k(rows, k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = df.filter("vec_id = 20")
    assert topk.top_k(few, F.col("vec_id") % 10 == 0).count() == 0


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", F.transform("v", lambda x: F.floor(1024 * x)).alias("v"))
    queries = df.filter("vec_id % 100 = 0")
    read = topk.survivors(df, queries, 10)
    assert 10 * 40 <= read.count() <= 25 * 40
    plan = topk.top_k(df.withColumnRenamed("v", "embedding"), F.col("vec_id") % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_hot_group_of_copies_is_cut_to_what_results_hold(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=8).tolist()) for i in range(3000)] + [(100, hot)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_top_k(rows, 10)
    used = df.select("vec_id", F.transform("embedding", lambda x: F.floor(1024 * x)).alias("v"))
    pairs = topk.survivors(used, used.filter("vec_id = 100").groupBy("vec_id").agg(F.min("v").alias("v")), 10)
    assert 10 <= pairs.count() <= 200


def test_a_file_scanned_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=7) + 3).tolist()) for i in range(2000)] + [(30, rng.normal(size=9).tolist()), (31, [0.5] * 3), (33, [1e4] * 7)]
    rows += [(i, None if i % 2 else [1.0, float("nan")]) for i in range(40, 60)]  # ids that also have usable rows
    for name, value in (("BLOCK_ROWS", 64), ("QUERY_ROWS", 50), ("HELD_BLOCKS", 2), ("SAMPLE_BLOCKS", 4), ("PARTED_BLOCKS", 16)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scans = []
    monkeypatch.setattr(topk, "stored", lambda part, at=topk.stored: scans.append(at(part)) or scans[-1])
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_top_k(rows, 10)
    # What tasks hand on follows the queries, not the queries times the tasks: the first sixteenth has a floor from the sample.
    assert len(scans) >= 6 and sum(x.count() for x in scans) < 200 * 150


def test_one_product_holds_three_scores():
    rng = np.random.default_rng(9)
    for dims in (1, 64, 500, 6000):
        vectors, queries = rng.integers(-(10**6), 10**6, (100, dims)), rng.integers(-(10**6), 10**6, (7, dims))
        vectors[3], queries[2], queries[3] = 10**6, 10**6, 0
        block, asked = topk.Approximation.of(vectors), topk.Queries(np.arange(7), queries)
        got = topk._products(topk._fields(asked.cells, block.packed(dims)), 100).astype(int) - topk.ZERO
        assert (got == asked.cells[:, :-1].astype(int) @ block.cells.T.astype(int)).all() and abs(got).max() < topk.ZERO


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(100, [3e15, 3e15]), (1, [3e15, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 100 == 0).collect()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale, dims in ((2000, 12), (3, 64), (10**9, 5), (10**12, 40)):
        vectors, queries = rng.integers(-scale, scale, (500, dims)), rng.integers(-scale, scale, (20, dims))
        vectors[:, 0] = 7
        products, lower, upper = topk.Approximation.of(vectors).bounds(queries)
        exact = queries.astype(object) @ vectors.T.astype(object)
        assert np.all((products + upper[:, None]).astype(object) >= exact) and np.all((products + lower[:, None]).astype(object) <= exact)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocab = {"en": "the of and house water light word".split(), "de": "der und größe straße zeit über haus".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(f"{rng.choice(vocab[lang])}{rng.choice('abcdefgh')}" for _ in range(rng.randrange(30, 120))), lang, f"s{i % 4}", None))
    rows += [(500, rows[4][1], "en", "s1", 3), (501, rows[4][1], "en", "s1", 3), (502, rows[5][1] + " tail", "en", "s2", 1), (503, None, "en", "s0", None), (504, "", "en", None, None), (505, "12 !", "de", "s0", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t, *_ in rows if i not in (503, 504, 505)}
    last = {}
    for i, t in sorted(texts.items()):
        last[t] = i
    unique = {i: texts[i] for i in last.values()}
    prints = {i: simhash.fingerprint(t) for i, t in unique.items()}
    kept = {i for i in unique if not any(j < i and bin(prints[i] ^ prints[j]).count("1") <= 4 for j in unique)}
    sources = {i: s for i, _, _, s, _ in rows}
    words = {}
    for i in kept:
        words[sources[i]] = words.get(sources[i], 0) + len(texts[i].split())
    goal, taken = plain_targets(words), {}
    codec = bpe.Codec(word_bpe_path())
    for r in got:
        assert r.doc_id in kept
        ids = codec.encode(texts[r.doc_id])
        assert list(r.ids) == ids.tolist() and r.decoded_sha256 == hashlib.sha256(codec.automaton.decode(ids).encode()).hexdigest()
        taken[r.source] = taken.get(r.source, 0) + len(texts[r.doc_id].split())
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert len(names) == 5
