"""Index life cycle, manifest, stored models, files and streams."""

import json
import random
import threading
import time
import warnings

import pytest
from pyspark.sql import functions as F

from quillmatch.functions.spooky import Hash, hash128
from quillmatch.operators import bag
from quillmatch.operators.match import PatternSet, find_matches
from quillmatch.sources import bag_store
from quillmatch.sources.files import content_hashes, read_files
from quillmatch.sources.index import PatternIndex, SegmentError
from quillmatch.sources.manifest import Manifest
from quillmatch.sources.segments import Matcher
from quillmatch.streaming import match_stream, read_documents


def ids(index, **options):
    return sorted(p.pattern_id for p in index.matcher(**options).active)


def test_life_cycle(spark, tmp_path):
    index = PatternIndex(spark, str(tmp_path / "index"))
    assert index.generation == 0 and ids(index) == []
    assert index.add_segment([(1, "alpha bravo"), (2, "***")]) == 1
    assert index.add_segment([(3, "charlie")]) == 2
    assert index.add_segment([]) == 2 and index.tombstone() == 2
    assert ids(index) == [1, 3]
    assert index.tombstone(1) == 3 and ids(index) == [3]
    with pytest.raises(ValueError):
        index.tombstone(3, 0)
    assert index.generation == 3
    assert index.add_segment([(1, "delta")]) == 4 and ids(index) == [1, 1, 3]
    old = {p.name for p in (tmp_path / "index").glob("*.seg")}
    assert index.merge([(1, "delta"), (3, "charlie")]) == 5 and ids(index) == [1, 3]
    assert old < {p.name for p in (tmp_path / "index").glob("*.seg")}
    index.merge()
    assert not old & {p.name for p in (tmp_path / "index").glob("*.seg")} and ids(index) == []


def test_bad_segments(spark, tmp_path):
    index = PatternIndex(spark, str(tmp_path / "index"))
    index.add_segment([(1, "alpha")])
    index.add_segment([(2, "bravo")])
    first = tmp_path / "index" / index.manifest().segments[0].file
    assert index.verify(first.name)
    good = first.read_text()
    for bad in (good.replace("alpha", "alpho"), good[:-3], "", "[]\n"):
        first.unlink()
        (tmp_path / "index" / f".{first.name}.crc").unlink(missing_ok=True)
        first.write_text(bad)
        assert not index.verify(first.name)
        with pytest.warns(UserWarning):
            assert ids(index) == [2]
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            assert ids(index, quiet=True) == [2]
        with pytest.raises(SegmentError):
            index.matcher(strict=True)


def test_folder_must_be_one(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        PatternIndex(spark, str(tmp_path / "file"))
    with pytest.raises(ValueError):
        PatternIndex(spark, "")


def test_manifest_is_cleaned():
    assert Manifest.parse("nonsense") == Manifest()
    assert Manifest.parse('{"format_version": 2, "generation": 5}') == Manifest()
    raw = {"format_version": 1, "generation": -1, "segments": [{"file": "x.seg"}, {"file": "../y"}, 7, {"checksum": "c"}], "tombstones": [5, 5, 0, "x", -1, 2**32, True]}
    m = Manifest.parse(json.dumps(raw))
    assert m.generation == 0 and [(s.file, s.checksum, s.pattern_count) for s in m.segments] == [("x.seg", "", 0)] and m.tombstones == [5, 0]
    assert Manifest.parse(m.text()) == m


def test_segments_equal_one_collection(spark, tmp_path):
    index = PatternIndex(spark, str(tmp_path / "index"))
    rows = [(1, "alpha bravo"), (2, "bravo $SKIP2 delta"), (3, "charlie")]
    for r in rows:
        index.add_segment([r])
    docs = spark.createDataFrame([(1, "alpha bravo charlie delta\ncharlie"), (2, "bravo x delta")], "doc_id int, text string")
    parts = {tuple(r) for r in find_matches(docs, index.matcher(), F.col("text"), "doc_id").collect()}
    index.merge(rows)
    assert parts == {tuple(r) for r in find_matches(docs, index.matcher(), F.col("text"), "doc_id").collect()} and parts


def test_stored_model(spark, tmp_path):
    p = spark.createDataFrame([(1, "red green"), (2, "red blue")], "pattern_id int, text string")
    weights = bag.idf(p, F.col("text"))
    vectors = bag.postings(p, F.col("text"), weights)
    folder = str(tmp_path / "bag")
    bag_store.dump(spark, {"idf": weights, "postings": vectors, "norms": bag.norms(vectors)}, folder)
    assert bag_store.verify(spark, folder) and bag_store.load(spark, folder)["idf"].count() == 3
    before = {x.name for x in (tmp_path / "bag").iterdir() if x.is_dir()}
    with pytest.raises(Exception):
        bag_store.dump(spark, {"idf": weights, "postings": vectors, "norms": weights.select(F.raise_error(F.lit("crash")))}, folder)
    assert bag_store.verify(spark, folder) and bag_store.load(spark, folder)["norms"].count() == 2
    bag_store.dump(spark, {"idf": weights, "postings": vectors, "norms": bag.norms(vectors)}, folder)
    (model,) = [x for x in (tmp_path / "bag").iterdir() if x.is_dir()]
    assert model.name not in before and bag_store.verify(spark, folder)
    weights.limit(1).write.mode("overwrite").parquet(f"{folder}/{model.name}/idf")
    assert not bag_store.verify(spark, folder)
    with pytest.raises(ValueError):
        bag_store.load(spark, folder)


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "empty").write_bytes(b"")
    (tmp_path / "full").write_bytes(b"a\0b")
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"empty": b"", "full": b"a\0b"}


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    from quillmatch.functions.patterns import parse_patterns

    patterns = PatternSet([parse_patterns([(1, "alpha $SKIP2 delta"), (2, "charlie")])], generation=3)
    docs = spark.createDataFrame([(i, "alpha x delta charlie" if i % 2 else "none") for i in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_documents(spark, str(tmp_path / "in"), docs.schema, files_at_once=1)
    query = match_stream(stream, patterns, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "ord", "pattern_id", "generation").collect()}
    expected = {(r.doc_id, r.ord, r.pattern_id, 3) for r in find_matches(docs, patterns, F.col("text"), "doc_id").collect()}
    assert got == expected and len(got) == 20


def test_a_merge_and_another_writer(spark, tmp_path):
    """A writer that comes while a merge runs waits, and its segment outlives the merge's sweep."""
    folder = str(tmp_path / "index")
    merging, adding = PatternIndex(spark, folder), PatternIndex(spark, folder)
    merging.add_segment([(1, "alpha")])
    sweep, started, other = merging._sweep, threading.Event(), []

    def slow_sweep(keep):
        started.set()
        time.sleep(1)  # the other writer is at the door by now
        sweep(keep)

    merging._sweep = slow_sweep
    thread = threading.Thread(target=lambda: (started.wait(), other.append(adding.add_segment([(2, "bravo")]))))
    thread.start()
    merging.merge([(1, "alpha")])
    thread.join()
    assert other == [3] and ids(adding, strict=True) == [1, 2]
    assert all(adding.verify(s.file) for s in adding.manifest().segments)


def test_many_writers(spark, tmp_path):
    index = PatternIndex(spark, str(tmp_path / "index"))
    threads = [threading.Thread(target=lambda i=i: index.add_segment([(i, f"word{i}")])) for i in range(1, 9)]
    threads += [threading.Thread(target=lambda: index.tombstone(1))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert index.generation == 9 and len(index.manifest().segments) == 8 and set(range(2, 9)) <= set(ids(index, strict=True))


def test_a_lock_left_by_a_crash_is_taken_over(spark, tmp_path):
    index = PatternIndex(spark, str(tmp_path / "index"), lock_seconds=1, stale_seconds=30)
    lock = tmp_path / "index" / "writer.lock"
    lock.write_text(json.dumps({"owner": "gone", "taken": time.time()}))
    with pytest.raises(TimeoutError):
        index.add_segment([(1, "alpha")])
    lock.unlink()
    lock.write_text(json.dumps({"owner": "gone", "taken": time.time() - 60}))
    assert index.add_segment([(1, "alpha")]) == 1 and not lock.exists()
    with pytest.raises(RuntimeError):
        with index._writing() as (m, _):
            m.bump()
            lock.unlink()
            lock.write_text(json.dumps({"owner": "thief", "taken": time.time()}))
    assert index.generation == 1 and json.loads(lock.read_text())["owner"] == "thief"


def test_matcher_from_segment_files(spark, tmp_path):
    one, two = Matcher(spark), Matcher(spark)
    one.add_pattern(1, ["alpha"])
    one.add_pattern(2, [])
    two.add_pattern(3, ["bravo", 2, "delta"])
    assert one.dump(str(tmp_path / "one.seg")) and two.dump(str(tmp_path / "two.seg"))
    m = Matcher(spark)
    assert m.load(str(tmp_path / "one.seg")) and m.attach(str(tmp_path / "two.seg"))
    docs = spark.createDataFrame([(1, "alpha bravo x delta")], "doc_id int, text string")
    assert [r.pattern_id for r in m.find_matches(docs, F.col("text"), "doc_id").collect()] == [3, 1]
    m.set_tombstones([3, 2**32 + 1, -1])
    assert [p.pattern_id for p in m.patterns().active] == [1]
    (tmp_path / "bad.seg").write_text("no segment")
    for path in ("bad.seg", "missing.seg", "."):
        assert not m.verify(str(tmp_path / path)) and not m.attach(str(tmp_path / path)) and not m.load(str(tmp_path / path))
    assert [p.pattern_id for p in m.patterns().patterns] == [1, 3]
    m.clear()
    assert m.patterns().patterns == [] and m.patterns().tombstones == frozenset()
    with pytest.raises(ValueError):
        m.add_pattern(0, ["x"])


def test_missing_paths(spark, tmp_path):
    assert read_files(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "there").write_text("abc")
    got = {r.path.rsplit("/", 1)[1]: r.content_hash for r in content_hashes(spark, [str(tmp_path / "there"), str(tmp_path / "missing")]).collect()}
    assert got == {"there": Hash().add("abc").hex(), "missing": "0" * 32}


def test_hash_in_parts():
    assert Hash().add("/* \n").add("** Invoke the authorization callback for permission to read column zCol from \n").add("** table zTab in database zDb. This function assumes that an authorization\n").hex() == "06a8354a1a3a0934b5b4c88496411563"
    rng = random.Random(1)
    for size in (0, 1, 191, 192, 193, 287, 288, 289, 1000, 5000):
        data, h, at = rng.randbytes(size), Hash(3, 4), 0
        while at < size:
            step = rng.choice([1, 7, 96, 100, 500])
            h.add(data[at : at + step])
            at += step
            assert h.hash128() == hash128(data[:at], 3, 4)
        assert h.hash128() == hash128(data, 3, 4) and len(h._rest) < 192


def test_catalogue_ids():
    assert bag.checked_patterns({"7": "x", 8: "y"}) == [(7, "x"), (8, "y")]
    for bad in ("0", "-1", "abc", " 1", "4294967296", 0, 2.5):
        with pytest.raises(ValueError):
            bag.checked_patterns({1: "good", bad: "x"})


def test_catalogue_scored_in_place_equals_joins(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    patterns = spark.createDataFrame([(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 9)))) for i in range(60)], "item int, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(vocab + ["zz"], k=rng.randrange(0, 12)))) for i in range(40)] + [(99, None)], "doc long, body string")
    for k in (0, 1, 4, 100):
        here = sorted(map(tuple, bag.best_for(asked, F.col("body"), patterns, F.col("text"), k, "doc", "item").collect()))
        with monkeypatch.context() as m:
            m.setattr(bag, "HELD_POSTINGS", 0)
            assert sorted(map(tuple, bag.best_for(asked, F.col("body"), patterns, F.col("text"), k, "doc", "item").collect())) == here
        assert len(here) == 41 * min(k, 60)
