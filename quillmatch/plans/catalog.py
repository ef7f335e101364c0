"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.functions.patterns import Pattern, parse_patterns, parse_tokens, words
from quillmatch.functions.spooky import token_hash
from quillmatch.operators import bag, distance, fingerprint, lines, match
from quillmatch.plans import sql
from quillmatch.sources import bag_store
from quillmatch.sources.files import read_files
from quillmatch.sources.index import PatternIndex
from quillmatch.sources.scratch import fresh_folder
from quillmatch.sources.segments import Matcher
from quillmatch.streaming import match_stream, read_documents

#: License phrases and wildcard patterns, as a catalogue would hold them.
PATTERNS = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "Released under the MIT License."),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "All rights reserved."),
    (5, "Licensed under CC BY-NC 4.0."),
    (6, "licensed under"),
    (7, "GNU $SKIP3 License"),
    (8, "licensed $SKIP2 the $SKIP5 license"),
    (9, "Apache License"),
    (10, "the $SKIP4 and $SKIP6 of the"),
    (11, "die $SKIP3 und"),
    (12, "de la"),
    (13, "MIT $SKIP License"),
]
#: A second segment: a repeated sequence, a text added again, new patterns.
LATER = [(14, "apache license"), (4, "rights reserved"), (15, "version $SKIP2 0"), (16, "est $SKIP9 pour")]
TOMBSTONES = frozenset({6, 9, 12})
K, W = 5, 8
#: Fingerprints of benchmark items that are broadcast.
BROADCAST_PRINTS = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return T.spread(_table(spark, sf_dir, "documents").select("doc_id", "text", *more), "doc_id")


def _patterns(rows: list[tuple[int, str]] = PATTERNS) -> match.PatternSet:
    return match.PatternSet([parse_patterns(rows)])


def tok_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.lines(_docs(spark, sf_dir), F.col("text"), "doc_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("text")).cast("long").alias("longest"))


def tok_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_rows(_docs(spark, sf_dir), F.col("text"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), "token")


def tok_vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"), "file").getField("token")).alias("token"), "doc_id")
    each = found.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


def tok_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"), "file")).alias("t"))
    return found.agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("t.token").alias("n_distinct"), F.sum("t.line").alias("sum_line"), F.sum(F.length("t.token")).alias("sum_length"))


def pattern_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, at, str(t)) for i, text in PATTERNS + LATER for at, t in enumerate(parse_tokens(text))]
    return spark.createDataFrame(rows, "pattern_id long, at long, token string").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("token").alias("last_word"))


def match_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.raw_matches(_docs(spark, sf_dir), _patterns(), F.col("text"), "doc_id")
    return _long(found, "start", "matched", "start_line", "end_line")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def match_literal_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r for r in PATTERNS if "$SKIP" not in r[1]]
    return _long(match.raw_matches(_docs(spark, sf_dir), _patterns(rows), F.col("text"), "doc_id"), "start", "matched", "start_line", "end_line")


def match_skip_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r for r in PATTERNS if "$SKIP" in r[1]]
    return _long(match.raw_matches(_docs(spark, sf_dir), _patterns(rows), F.col("text"), "doc_id"), "start", "matched", "start_line", "end_line")


def _resolved(spark: SparkSession, sf_dir: str, patterns: match.PatternSet, table: str = "documents", text: Column | None = None, *keep: str) -> DataFrame:
    docs = T.spread(_table(spark, sf_dir, table), (keep or ("doc_id",))[0])
    found = match.find_matches(docs, patterns, F.col("text") if text is None else text, *(keep or ("doc_id",)))
    return _long(found, "ord", "start_line", "end_line")


def match_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, _patterns())


def match_multi_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segment files, written and attached one after the other."""
    matcher, folder = Matcher(spark), fresh_folder(spark)
    for name, rows in (("first.seg", PATTERNS), ("second.seg", LATER)):
        one = Matcher(spark)
        for i, text in rows:
            one.add_pattern(i, parse_tokens(text))
        if not (one.dump(f"{folder}/{name}") and matcher.verify(f"{folder}/{name}") and matcher.attach(f"{folder}/{name}")):
            raise OSError(f"{folder}/{name} cannot be attached")
    return _resolved(spark, sf_dir, matcher.patterns())


def _index(spark: SparkSession) -> PatternIndex:
    """A new index of the patterns as one segment."""
    index = PatternIndex(spark, fresh_folder(spark))
    index.add_segment(PATTERNS)
    return index


def match_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second segment is added to the index, then some ids are hidden."""
    index = _index(spark)
    index.add_segment(LATER)
    index.tombstone(*TOMBSTONES)
    return _resolved(spark, sf_dir, index.matcher(strict=True))


def match_readded_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id 4 is hidden and then added again: its old and new text both match."""
    index = _index(spark)
    index.tombstone(4, *TOMBSTONES)
    index.add_segment(LATER)
    return _resolved(spark, sf_dir, index.matcher(strict=True))


def match_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a merge only the authoritative text of id 4 is left."""
    index = _index(spark)
    index.tombstone(4, 9)
    index.add_segment(LATER)
    index.merge(_merged())
    return _resolved(spark, sf_dir, index.matcher(strict=True))


def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after every step of its life: generation, sound segments, tombstones, active patterns."""
    index, rows = PatternIndex(spark, fresh_folder(spark)), []

    def note(step: str) -> None:
        m = index.manifest()
        rows.append((step, index.generation, sum(index.verify(x.file) for x in m.segments), sum(x.pattern_count for x in m.segments), len(m.tombstones), len(index.matcher(strict=True).active)))

    note("0 new")
    for step, act in (
        ("1 add", lambda: index.add_segment(PATTERNS)),
        ("2 tombstone", lambda: index.tombstone(4, *TOMBSTONES)),
        ("3 add", lambda: index.add_segment(LATER)),
        ("4 nothing", lambda: (index.add_segment([(7, "***")]), index.tombstone())),
        ("5 merge", lambda: index.merge(_merged())),
        ("6 merge of nothing", lambda: index.merge()),
    ):
        act()
        note(step)
    return spark.createDataFrame(rows, "step string, generation long, sound long, patterns long, tombstones long, active long")


def match_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations matched as they arrive, with the pattern set's generation."""
    index, folder = _index(spark), fresh_folder(spark)
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    turns.write.parquet(f"{folder}/in")
    query = match_stream(read_documents(spark, f"{folder}/in", turns.schema), index.matcher(strict=True), f"{folder}/out", f"{folder}/state", "turn_id")
    query.awaitTermination()
    found = spark.read.schema("turn_id long, ord int, pattern_id long, start_line int, end_line int, generation long").parquet(f"{folder}/out")
    return _long(found.select("turn_id", "ord", "pattern_id", "start_line", "end_line", "generation"), "ord", "start_line", "end_line")


def files_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts written as files, read back whole and tokenised; a missing path adds nothing."""
    folder = fresh_folder(spark)
    _table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(folder)
    files = read_files(spark, folder).unionByName(read_files(spark, f"{folder}/missing"))
    found = files.select(F.explode(T.tokens(F.decode("content", "UTF-8"), "file").getField("token")).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def match_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of patterns: three words, one or two free ones and two more, from all places of all benchmark texts."""
    patterns = []
    for row in _table(spark, sf_dir, "benchmark").select("item_id", "text").orderBy("item_id").collect():
        w = words(row["text"] or "")
        patterns += [Pattern.of(row["item_id"] * 1000 + i + 1, [*w[i : i + 3], 2, *w[i + 4 : i + 6]]) for i in range(len(w) - 5)]
    return _long(match.raw_matches(_docs(spark, sf_dir), match.PatternSet([patterns]), F.col("text"), "doc_id"), "start", "matched", "start_line", "end_line")


def _merged() -> list[tuple[int, str]]:
    return sorted(dict(PATTERNS + LATER).items())


def license_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "source")
    found = match.find_matches(docs, _patterns(), F.col("text"), "doc_id", "source")
    return found.groupBy("source", "pattern_id").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("doc_id").alias("n_docs"))


def conversations_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.find_matches(_table(spark, sf_dir, "conversations"), _patterns(), F.col("text"), "conv_id", "turn")
    return _long(found, "ord", "start_line", "end_line")


def pages_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, _patterns(), "pages", F.col("html"), "page_id")


def read_lines_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around every resolved license match's start."""
    docs = _docs(spark, sf_dir)
    found = match.find_matches(docs, _patterns(PATTERNS[:5]), F.col("text"), "doc_id")
    wanted = found.groupBy("doc_id", F.col("start_line").alias("line")).agg(F.max("pattern_id").alias("value"))
    got = lines.read_lines(docs, F.col("text"), wanted)
    return got.select("doc_id", F.col("line").cast("long").alias("line"), "value", F.decode("text", "UTF-8").alias("text"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprint.content_hash(_docs(spark, sf_dir), F.col("text"), "doc_id")
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).select("first_id", "copies")


def content_hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.content_hash(_docs(spark, sf_dir), F.col("text"), "doc_id")


def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every different token: the vocabulary is hashed, not the texts."""
    found = _docs(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("text"), "file").getField("token"))).alias("token")).distinct()
    return found.select("token", token_hash(F.col("token")).alias("hash"))


def bag_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bag.idf(_table(spark, sf_dir, "benchmark"), F.col("text"), "item_id")
    return found.select("token", "df", F.round("idf", 6).alias("idf"))


def bag_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    vectors = bag.postings(items, F.col("text"), bag.idf(items, F.col("text"), "item_id"), "item_id")
    return bag.norms(vectors, "item_id").select("item_id", F.round("norm", 6).alias("norm"))


def bag_stored_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of a model that was written, checked and loaded."""
    items, folder = _table(spark, sf_dir, "benchmark"), fresh_folder(spark)
    weights = bag.idf(items, F.col("text"), "item_id")
    vectors = bag.postings(items, F.col("text"), weights, "item_id")
    bag_store.dump(spark, {"idf": weights, "postings": vectors, "norms": bag.norms(vectors, "item_id")}, folder)
    return bag_store.load(spark, folder)["norms"].select("item_id", F.round("norm", 6).alias("norm"))


def bag_best_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumnRenamed("text", "body")
    found = bag.best_for(docs, F.col("body"), _table(spark, sf_dir, "benchmark"), F.col("text"), 3, "doc_id", "item_id")
    return found.select("doc_id", "item_id", "match", F.col("rank").cast("long").alias("rank"))


def token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from each turn of a conversation to the next."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.pattern_tokens(F.col("text")).alias("toks"))
    last = F.lag("toks").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("last", last).filter("last is not null").select("conv_id", "turn", distance.token_distance(F.col("last"), F.col("toks")).cast("long").alias("edits"))


def winnow_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.winnow_rows(_docs(spark, sf_dir), F.col("text"), "doc_id", K, W)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "fp")


def winnow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.winnow_rows(_docs(spark, sf_dir), F.col("text"), "doc_id", K, W)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_line") - F.col("start_line")).cast("long").alias("lines"), F.min("start_line").cast("long").alias("first"), F.max("end_line").cast("long").alias("last"))


def winnow_spooky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir), F.col("text"), "doc_id", K, W, chunk_bytes=T.CHUNK_BYTES)


def segment_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose fingerprints a document holds."""
    items = fingerprint.winnow_rows(_table(spark, sf_dir, "benchmark"), F.col("text"), "item_id", K, W).select("item_id", "fp").distinct()
    docs = fingerprint.winnow_rows(_docs(spark, sf_dir), F.col("text"), "doc_id", K, W).select("doc_id", "fp")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    # Few fingerprints go to the documents, so that only those met are shuffled; else each is joined once.
    met = docs.join(F.broadcast(items), "fp") if items.count() <= BROADCAST_PRINTS else docs.distinct().join(items, "fp")
    shared = met.distinct().groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "item_id").filter(F.col("shared") * 2 >= F.col("size")).select("item_id", "doc_id", "shared", "size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tok_lines, tok_normalize, tok_vocab_df, tok_stats, pattern_parse, match_literal_raw, match_skip_raw, match_raw, match_resolved,
        match_multi_segment, match_tombstoned, match_readded_id, match_after_merge, license_counts_by_source, conversations_matches, pages_matches,
        read_lines_window, content_dedup, content_hash_hex, token_hashes, bag_idf, bag_norms, bag_best_for, token_distance, winnow_md5, winnow_spans,
        winnow_spooky, segment_crc, containment_pairs, index_states, match_streamed, match_many_patterns, files_tokens, bag_stored_norms,
    )
}

_TOK = sql.tokens("documents", "doc_id", "text")
_RAW = "SELECT doc_id, start, matched, pattern_id, start_line, end_line FROM raw"


#: What the patterns mean, written out by hand: runs of words, and how many free words stand before each.
_FIRST = [
    (1, [("licensed under the apache license version 2.0", 0, 0)]),
    (2, [("released under the mit license", 0, 0)]),
    (3, [("this work is licensed under the gnu general public license version 3", 0, 0)]),
    (4, [("all rights reserved", 0, 0)]),
    (5, [("licensed under by-nc 4.0", 0, 0)]),
    (6, [("licensed under", 0, 0)]),
    (7, [("gnu", 0, 0), ("license", 1, 3)]),
    (8, [("licensed", 0, 0), ("the", 1, 2), ("license", 1, 5)]),
    (9, [("apache license", 0, 0)]),
    (10, [("the", 0, 0), ("and", 1, 4), ("of the", 1, 6)]),
    (11, [("die", 0, 0), ("und", 1, 3)]),
    (12, [("de la", 0, 0)]),
    (13, [("mit $skip license", 0, 0)]),
]
_SECOND = [(14, [("apache license", 0, 0)]), (4, [("rights reserved", 0, 0)]), (15, [("version", 0, 0), ("0", 1, 2)]), (16, [("est", 0, 0), ("pour", 1, 9)])]
_BOTH = _FIRST + _SECOND
#: After the merge 14, added later, stands for 9, which is the same sequence.
_MERGED = [p for p in _FIRST if p[0] not in (4, 9)] + _SECOND


def _raw_sql(patterns: list) -> str:
    return f"WITH {sql.raw_matches('documents', 'doc_id', 'text', patterns)} {_RAW}"


def _best_sql(patterns: list, table: str = "documents", key: str = "doc_id", text: str = "text", end: str = "") -> str:
    end = end or f"SELECT {key}, ord, pattern_id, start_line, end_line FROM best"
    return f"WITH {sql.raw_matches(table, key, text, patterns)}, {sql.resolved(key)} {end}"


_BAG = f"""
    bw AS (SELECT item_id, unnest(list_distinct({sql.words("text")})) AS token FROM benchmark),
    idf AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM bw GROUP BY token),
    vec AS (SELECT item_id, token, idf FROM bw JOIN idf USING (token)),
    norm AS (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM vec GROUP BY item_id)"""


def _grams_sql(table: str, key: str, prefix: str) -> str:
    return f"""
        {prefix}g AS (
            SELECT {key}, pos, line, string_agg(token, ' ') OVER r AS gram, max(line) OVER r AS last, count(*) OVER (PARTITION BY {key}) AS n
            FROM {prefix}tok WINDOW r AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)),
        {prefix}h AS (SELECT *, md5(gram) AS fp FROM {prefix}g WHERE pos <= n - {K}),
        {prefix}m AS (
            SELECT {key}, pos, n, min({{'fp': fp, 'back': -pos, 'line': line, 'last': last}}) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS x
            FROM {prefix}h),
        {prefix}w AS (SELECT DISTINCT {key}, -x.back AS pos, x.fp AS fp, x.line AS start_line, x.last AS end_line FROM {prefix}m WHERE pos <= n - {K} - {W} + 1)"""


def _prefixed(cte: str, prefix: str) -> str:
    for name in ("lines", "found", "flat", "tok"):
        cte = cte.replace(f" {name} AS", f" {prefix}{name} AS").replace(f"FROM {name}", f"FROM {prefix}{name}")
    return cte


ORACLE_SQL: dict[str, str] = {
    "tok_lines": "SELECT doc_id, count(*) AS n_lines, max(len(l)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id",
    "tok_normalize": f"WITH {_TOK} SELECT doc_id, pos, line, token FROM tok",
    "tok_vocab_df": f"WITH {_TOK} SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY token",
    "tok_stats": f"WITH {_TOK} SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, sum(line)::BIGINT AS sum_line, sum(len(token))::BIGINT AS sum_length FROM tok",
    "pattern_parse": f"""
        WITH p(pattern_id, text) AS (VALUES {", ".join(f"({i}::BIGINT, {sql.quoted(t)})" for i, t in PATTERNS + LATER)}),
        w AS (SELECT pattern_id, {sql.words("text")} AS w FROM p),
        t AS (SELECT pattern_id, list_transform(w, lambda t: CASE WHEN regexp_full_match(t, '\\$skip[0-9]{{1,2}}') THEN substr(t, 6) ELSE t END) AS w FROM w)
        SELECT pattern_id, sum(len(w))::BIGINT AS n_tokens, max(list_max(w)) AS last_word FROM t GROUP BY pattern_id""",
    "match_literal_raw": _raw_sql([p for p in _FIRST if len(p[1]) == 1 and p[0] != 13]),
    "match_skip_raw": _raw_sql([p for p in _FIRST if len(p[1]) > 1 or p[0] == 13]),
    "match_raw": _raw_sql(_FIRST),
    "match_resolved": _best_sql(_FIRST),
    "match_multi_segment": _best_sql(_BOTH),
    "match_tombstoned": _best_sql([p for p in _BOTH if p[0] not in (6, 9, 12)]),
    "match_readded_id": _best_sql([p for p in _BOTH if p[0] not in (6, 9, 12)]),
    "match_after_merge": _best_sql(_MERGED),
    "license_counts_by_source": _best_sql(_FIRST, end="SELECT source, pattern_id, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM best JOIN documents USING (doc_id) GROUP BY source, pattern_id"),
    "conversations_matches": _best_sql(_FIRST, "(SELECT conv_id * 1000000 + turn AS k, text FROM conversations)", "k", end="SELECT k // 1000000 AS conv_id, k % 1000000 AS turn, ord, pattern_id, start_line, end_line FROM best"),
    "pages_matches": _best_sql(_FIRST, "pages", "page_id", "html"),
    "match_streamed": _best_sql(
        _FIRST, "(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)", "turn_id", end="SELECT turn_id, ord, pattern_id, start_line, end_line, 1::BIGINT AS generation FROM best"
    ),
    "match_many_patterns": f"""
        WITH {sql.raw_matches("documents", "doc_id", "text", f'''
            given AS (SELECT item_id, {sql.words("text")} AS w FROM benchmark),
            places AS (SELECT item_id, w, unnest(range(0, len(w) - 5)) AS i FROM given),
            whole AS (SELECT max(item_id * 1000 + i + 1)::BIGINT AS pattern_id, w[i + 1 : i + 3] AS a, w[i + 5 : i + 6] AS b FROM places GROUP BY a, b),
            piece(pattern_id, n, nth, words, least, most) AS (SELECT pattern_id, 2, 0, a, 0, 0 FROM whole UNION ALL SELECT pattern_id, 2, 1, b, 1, 2 FROM whole)''')}
        {_RAW}""",
    "index_states": """
        SELECT * FROM (VALUES ('0 new', 0, 0, 0, 0, 0), ('1 add', 1, 1, 13, 0, 13), ('2 tombstone', 2, 1, 13, 4, 9), ('3 add', 3, 2, 17, 3, 14),
                              ('4 nothing', 3, 2, 17, 3, 14), ('5 merge', 4, 1, 16, 0, 15), ('6 merge of nothing', 5, 1, 0, 0, 0))
            AS t(step, generation, sound, patterns, tombstones, active)""",
    "files_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({sql.words('text')}) AS token FROM benchmark) GROUP BY token",
    "token_distance": f"""
        WITH t AS (SELECT conv_id, turn, {sql.words("text")} AS w FROM conversations),
        p AS (SELECT conv_id, turn, w[1 : len(w) - 1] AS y, lag(w[1 : len(w) - 1]) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM t),
        c AS (SELECT conv_id, turn, range(0, len(y) + 1) AS start, list_transform(x, lambda t: list_transform(y, lambda u: (t <> u)::BIGINT)) AS costs FROM p WHERE x IS NOT NULL)
        SELECT conv_id, turn,
               list_reduce(costs, lambda row, cost: list_reduce(list_transform(range(1, len(row)), lambda j: [least(row[j + 1] + 1, row[j] + cost[j])]),
                           lambda done, best: list_concat(done, [least(done[-1] + 1, best[1])]), [row[1] + 1]), start)[-1]::BIGINT AS edits
        FROM c""",
    "read_lines_window": _best_sql(
        _FIRST[:5],
        end="SELECT b.doc_id, b.line, b.value, l.text FROM (SELECT doc_id, start_line AS line, max(pattern_id) AS value FROM best GROUP BY doc_id, start_line) b JOIN lines l ON l.doc_id = b.doc_id AND l.line = b.line",
    ),
    "content_dedup": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text)",
    "bag_idf": f"WITH {_BAG} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bag_norms": f"WITH {_BAG} SELECT item_id, round(norm, 6) AS norm FROM norm",
    "bag_stored_norms": f"WITH {_BAG} SELECT item_id, round(norm, 6) AS norm FROM norm",
    "bag_best_for": f"""
        WITH {_BAG},
        q AS (SELECT doc_id, token, idf FROM (SELECT doc_id, unnest(list_distinct({sql.words("text")})) AS token FROM documents) JOIN idf USING (token)),
        own AS (SELECT doc_id, sqrt(sum(idf * idf)) AS own FROM q GROUP BY doc_id),
        dots AS (SELECT q.doc_id, v.item_id, sum(q.idf * v.idf) AS dot FROM q JOIN vec v USING (token) GROUP BY q.doc_id, v.item_id),
        s AS (
            SELECT d.doc_id, b.item_id, coalesce(CASE WHEN norm > 0 AND own > 0 THEN dot / norm / own ELSE 0 END, 0) AS raw
            FROM documents d CROSS JOIN benchmark b LEFT JOIN dots USING (doc_id, item_id) LEFT JOIN norm USING (item_id) LEFT JOIN own USING (doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, item_id) AS rank FROM s)
        SELECT doc_id, item_id, floor(raw * 10000 + 1e-7) / 10000 AS match, rank FROM r WHERE rank <= 3""",
    "winnow_md5": f"WITH {_TOK}, {_grams_sql('documents', 'doc_id', '')} SELECT doc_id, pos, fp FROM w",
    "winnow_spans": f"WITH {_TOK}, {_grams_sql('documents', 'doc_id', '')} SELECT doc_id, count(*) AS n, sum(end_line - start_line)::BIGINT AS lines, min(start_line) AS first, max(end_line) AS last FROM w GROUP BY doc_id",
    "containment_pairs": f"""
        WITH {_TOK}, {_grams_sql("documents", "doc_id", "")}, {_prefixed(sql.tokens("benchmark", "item_id", "text"), "b")}, {_grams_sql("benchmark", "item_id", "b")},
        i AS (SELECT DISTINCT item_id, fp FROM bw), d AS (SELECT DISTINCT doc_id, fp FROM w),
        z AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
        s AS (SELECT item_id, doc_id, count(*) AS shared FROM d JOIN i USING (fp) GROUP BY item_id, doc_id)
        SELECT item_id, doc_id, shared, size FROM s JOIN z USING (item_id) WHERE shared * 2 >= size""",
}
