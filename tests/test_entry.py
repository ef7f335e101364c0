"""The catalogue: its names, its SQL, and what is left without the subpackage."""

import os
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillmatch.functions import patterns, spooky
from quillmatch.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_works_without_the_subpackage(tmp_path):
    """Both folders and the pipeline are really gone from a copy; the rest imports and answers."""
    for part in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / part, tmp_path)
    shutil.copytree(ROOT / "quillmatch", tmp_path / "quillmatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert [int(x) for x in out.stdout.split()] == [len(catalog.QUERIES), len(catalog.ORACLE_SQL)]


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quillmatch", tmp_path / "quillmatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode and "no_such_module" in out.stderr


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["tok_normalize", "match_resolved", "match_tombstoned", "bag_best_for", "winnow_md5", "index_states", "match_many_patterns", "match_streamed", "files_tokens", "bag_stored_norms", "token_distance"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})")
    expected = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == expected


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_queries_without_sql_against_plain_loops(spark, texts):
    got = {r.doc_id: r.crc for r in catalog.segment_crc(spark, DATA).collect()}
    assert got == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
    got = {r.doc_id: r.content_hash for r in catalog.content_hash_hex(spark, DATA).collect()}
    assert got == {i: spooky.Hash().add(t).hex() for i, t in texts.items()}
    tokens = {i: [(n, w) for n, line in enumerate(t.split("\n"), 1) for w in patterns.words(line)] for i, t in texts.items()}
    known = {w: spooky.hash128(w.encode(), 1, 1)[0] for found in tokens.values() for _, w in found}
    got = {r.token: r.hash % 2**64 for r in catalog.token_hashes(spark, DATA).collect()}
    assert got == known
    expected = set()
    for i, found in tokens.items():
        if len(texts[i]) > 3000:
            continue
        grams = []
        for at in range(len(found) - catalog.K + 1):
            h = 1469598103934665603
            for _, w in found[at : at + catalog.K]:
                h = (h ^ known[w]) * 1099511628211 % 2**64
            grams.append(h)
        for at in range(len(grams) - catalog.W + 1):
            pos = min(range(at, at + catalog.W), key=lambda k: (grams[k], -k))
            expected.add((i, pos, grams[pos], found[pos][0], found[pos + catalog.K - 1][0]))
    got = {(r.doc_id, r.pos, r.fp % 2**64, r.start_line, r.end_line) for r in catalog.winnow_spooky(spark, DATA).collect() if len(texts[r.doc_id]) <= 3000}
    assert got == expected and len(got) > 100


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("few", [True, False])
def test_documents_prints_are_not_shuffled_to_meet_few_items(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(catalog, "BROADCAST_PRINTS", 0)
    df = catalog.containment_pairs(spark, DATA)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = con.execute(f"SELECT item_id, doc_id, shared, size FROM ({catalog.ORACLE_SQL['containment_pairs']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=broadcast)" in plan) == few
