"""The ``opN_*`` queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import boilerplate, bpe, exact_dedup, html_text, langid, mixing, pii, simhash, substring_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.clean_pages(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring_dedup.dedup_substrings(docs)

    def covered(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")

    return done.select(
        "doc_id",
        (F.size("__repeated") > 0).alias("repeated"),
        covered("__repeated").alias("repeated_chars"),
        covered("__removed").alias("removed_chars"),
        written("__repeated").alias("repeated_spans"),
        written("__removed").alias("removed_spans"),
        F.col("__text").alias("text"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def word_bpe_path() -> str:
    """Where the public word-level vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), word_bpe_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def written(spans: Column) -> Column:
        order = F.array(*[F.lit(k) for k in pii.ORDER])
        placed = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    every = written(F.concat("base", "added")).alias("spans")
    every_count = (F.size("base") + F.size("added")).cast("long")
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), every, F.size("added").cast("long").alias("n_added"), (every_count > 0).alias("personal"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = langid.train(docs.filter(~held_out), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_topk": op8_exact_topk,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS nth FROM d)
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op7_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
            FROM documents),
        s AS (
            SELECT source, words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r
            FROM (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source)),
        w AS (SELECT source, words, CASE r WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * words AS top FROM s),
        p AS (
            SELECT *, sum(words) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
                   coalesce(sum(top) OVER (ORDER BY top / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
                   sum(weight) OVER (ORDER BY top / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
                   row_number() OVER (ORDER BY top / weight) AS k
            FROM w),
        c AS (SELECT (budget - fixed) / free AS level FROM p WHERE weight * ((budget - fixed) / free) <= top ORDER BY k LIMIT 1),
        t AS (SELECT source, words, CASE WHEN weight * level > top THEN top ELSE weight * level END AS target FROM p, c),
        b AS (SELECT source, len(bin(size)) AS bits, sum(size)::BIGINT AS inside FROM d WHERE size > 0 GROUP BY ALL),
        f AS (
            SELECT b.*, t.words, t.target,
                   (t.target - 2.0::DOUBLE * coalesce(sum(inside) OVER (PARTITION BY b.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / sum(inside * bits) OVER (PARTITION BY b.source ORDER BY bits ROWS UNBOUNDED PRECEDING)::DOUBLE AS own
            FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
        v AS (SELECT source, arg_max(own, bits) FILTER (WHERE own * bits <= 2) AS level FROM f GROUP BY source),
        e AS (SELECT f.*, least(2.0::DOUBLE, coalesce(level * bits, 2.0::DOUBLE)) AS copies FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source),
        g AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS pi, target - sum(floor(copies)::BIGINT * inside) OVER (PARTITION BY source) AS rest FROM e),
        j AS (
            SELECT d.doc_id, d.source, d.size, t.words, t.target, coalesce(g.whole, 0) AS whole, g.rest,
                   CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.size > 0 AND len(bin(d.size)) = g.bits),
        o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM j)
        SELECT doc_id, size, words AS source_size, target,
               (size * (whole + CASE WHEN q IS NULL OR start > rest THEN 0 WHEN size = 0 THEN 1 WHEN (rest - start) / size >= 0.5 THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM o
    """,
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op1_line_dedup": rf"""
        WITH a AS (
            SELECT page_id, lower(coalesce(regexp_extract(url, '{boilerplate.HOST}', 1), '')) AS host,
                   regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{boilerplate.UNSEEN}', '', 'g'), '{boilerplate.BREAKS}', chr(10), 'g'), '{boilerplate.MARKUP}', '', 'g') AS t
            FROM pages),
        b AS (
            SELECT page_id, host, list_filter(list_transform(string_split(regexp_replace(
                   replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
                   '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
            FROM a),
        n AS (SELECT host, count(*) AS pages FROM b GROUP BY host),
        e AS (SELECT host, unnest(list_distinct(lines)) AS line FROM b),
        c AS (SELECT e.host, line FROM e JOIN n USING (host) GROUP BY e.host, line, pages HAVING count(*) >= {boilerplate.MIN_PAGES} AND count(*) > {boilerplate.MAX_RATIO}::DOUBLE * pages),
        s AS (SELECT host, list(line) AS common FROM c GROUP BY host),
        k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), false)) AS kept FROM b LEFT JOIN s USING (host))
        SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
    """,
}
