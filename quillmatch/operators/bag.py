"""Closest patterns of a text by tf-idf cosine over distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillmatch.functions.patterns import checked_id
from quillmatch.functions.text import until_nul, words

#: Postings of all patterns that are held in memory; beyond that scoring is a join.
HELD_POSTINGS = 10_000_000
#: Cells of the score table that a worker fills at once.
_CELLS_AT_ONCE = 1 << 22


def bag_words(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """Rows (key, token): the distinct words of each text."""
    return rows.select(key, F.explode(F.array_distinct(words(until_nul(text)))).alias("token"))


def checked_patterns(rows: dict[int | str, str]) -> list[tuple[int, str]]:
    """Rows (id, text) of a catalogue; one bad id and none are taken.

    Ids are whole numbers, also as plain digits, from 1 up to 32 bits.
    """
    ids = [int(i) if isinstance(i, str) and i.isascii() and i.isdigit() else i for i in rows]
    return [(checked_id(i), text) for i, text in zip(ids, rows.values(), strict=True)]


def idf(patterns: DataFrame, text: Column, key: str = "pattern_id") -> DataFrame:
    """Rows (token, df, idf) with idf = ln(patterns / df), empty patterns counted."""
    counted = bag_words(patterns, text, key).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = patterns.agg(F.count(F.lit(1)).alias("n_patterns"))
    return counted.join(F.broadcast(total)).select("token", "df", F.log(F.col("n_patterns") / F.col("df")).alias("idf"))


def postings(patterns: DataFrame, text: Column, weights: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Rows (key, token, idf): the vectors of patterns or, for unknown words less, of texts."""
    return bag_words(patterns, text, key).join(weights.select("token", "idf"), "token")


def norms(vectors: DataFrame, key: str = "pattern_id") -> DataFrame:
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))


def best_for(queries: DataFrame, query_text: Column, patterns: DataFrame, pattern_text: Column, k: int, query_key: str = "query_id", key: str = "pattern_id") -> DataFrame:
    """Rows (query_key, key, match, rank): the k closest patterns of each query.

    Scores are cut, not rounded, to four decimals after ranking.  Patterns that
    share no word with a query have score 0 and fill its list up, smallest ids
    first.  The catalogue's postings are counted: up to ``HELD_POSTINGS`` they
    are broadcast and each query is scored where it is read, so no query is
    shuffled and no pair of query and pattern is ever a row; a larger catalogue
    is scored by joins.
    """
    if k <= 0:
        return queries.select(query_key).limit(0).select(query_key, F.lit(0).cast("long").alias(key), F.lit(0.0).alias("match"), F.lit(0).alias("rank"))
    bags = patterns.select(key, F.array_distinct(words(until_nul(pattern_text))).alias("words"))
    if (bags.agg(F.sum(F.size("words"))).first()[0] or 0) > HELD_POSTINGS:
        top = _scored_by_joins(queries, query_text, patterns, pattern_text, k, query_key, key)
    else:
        top = _scored_in_place(queries.select(query_key, F.array_distinct(words(until_nul(query_text))).alias("words")), bags, k, query_key, key)
    return top.select(query_key, key, (F.floor(F.col("raw") * 10000 + 1e-7) / 10000).alias("match"), "rank")


class _Postings:
    """All patterns' vectors by word; patterns are numbered in the order of their ids."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in sorted(rows)]
        own = {i: n for n, i in enumerate(self.ids)}
        holders: dict[str, list[int]] = {}
        for i, tokens in rows:
            for t in tokens or []:
                holders.setdefault(t, []).append(own[i])
        self.words = {t: n for n, t in enumerate(holders)}
        self.idf = np.array([np.log(len(rows) / len(h)) for h in holders.values()])
        self.ends = np.cumsum([0, *map(len, holders.values())])
        self.holders = np.fromiter((n for h in holders.values() for n in h), np.int64, self.ends[-1])
        spread = np.repeat(self.idf * self.idf, np.diff(self.ends))
        self.norms = np.sqrt(np.bincount(self.holders, spread, len(rows)))

    def best(self, tokens: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, given by word numbers, its k best patterns and their scores."""
        n = len(self.ids)
        k = min(k, n)
        step = max(1, min(_CELLS_AT_ONCE // max(n, 1), _CELLS_AT_ONCE // max(len(self.holders), 1)))
        for start in range(0, len(tokens), step):
            some = tokens[start : start + step]
            flat = np.concatenate(some).astype(np.int64)
            sizes = self.ends[flat + 1] - self.ends[flat]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held = self.holders[np.repeat(self.ends[flat], sizes) + inside]
            row = np.repeat(np.repeat(np.arange(len(some)), [len(t) for t in some]), sizes)
            scores = np.bincount(row * n + held, np.repeat(self.idf[flat] ** 2, sizes), len(some) * n).reshape(len(some), n)
            owns = np.sqrt([float((self.idf[t] ** 2).sum()) for t in some])
            for line, own in zip(scores, owns, strict=True):
                raw = np.divide(line, self.norms * own, out=np.zeros(n), where=(self.norms > 0) & (own > 0))
                ranked = -np.round(raw, 9)
                if n > k:  # all that reach the k-th score, ties included
                    near = np.flatnonzero(ranked <= np.partition(ranked, k - 1)[k - 1])
                else:
                    near = np.arange(n)
                near = near[np.argsort(ranked[near], kind="stable")][:k]
                yield near, raw[near]


def _scored_in_place(asked: DataFrame, bags: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    rows = [(r[0], r[1]) for r in bags.collect()]
    shared = asked.sparkSession.sparkContext.broadcast(_Postings(rows))
    kind = to_arrow_type(bags.schema[key].dataType)
    schema = T.StructType([asked.schema[query_key], bags.schema[key], T.StructField("raw", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            coded = batch.column(1).flatten().dictionary_encode()
            known = np.array([own.words.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
            numbers = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            ends = np.cumsum([0, *batch.column(1).value_lengths().fill_null(0).to_pylist()])
            tokens = [numbers[a:b][numbers[a:b] >= 0] for a, b in zip(ends, ends[1:], strict=False)]
            at, ids, raws, ranks = [], [], [], []
            for row, (near, raw) in enumerate(own.best(tokens, k) if own.ids else ()):
                at += [row] * len(near)
                ids += [own.ids[n] for n in near.tolist()]
                raws.append(raw)
                ranks.append(np.arange(1, len(near) + 1, dtype=np.int32))
            if at:
                columns = [batch.column(0).take(pa.array(at)), pa.array(ids, kind), pa.array(np.concatenate(raws)), pa.array(np.concatenate(ranks))]
                yield pa.RecordBatch.from_arrays(columns, names=[query_key, key, "raw", "rank"])

    return asked.mapInArrow(run, schema)


def _scored_by_joins(queries: DataFrame, query_text: Column, patterns: DataFrame, pattern_text: Column, k: int, query_key: str, key: str) -> DataFrame:
    """The same by equi-joins; of the patterns without a shared word only the 2k smallest ids can be needed."""
    weights = idf(patterns, pattern_text, key)
    vectors = postings(patterns, pattern_text, weights, key)
    asked = postings(queries, query_text, weights, query_key)
    dots = asked.join(vectors.select(key, "token", F.col("idf").alias("w")), "token").groupBy(query_key, key).agg(F.sum(F.col("idf") * F.col("w")).alias("dot"))
    scored = dots.join(norms(vectors, key), key).join(norms(asked, query_key).withColumnRenamed("norm", "own"), query_key)
    raw = F.when((F.col("norm") > 0) & (F.col("own") > 0), F.col("dot") / F.col("norm") / F.col("own")).otherwise(0.0)
    scored = scored.select(query_key, key, raw.alias("raw"))
    order = Window.partitionBy(query_key).orderBy(F.round("raw", 9).desc(), key)
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    filling = patterns.select(key).orderBy(key).limit(2 * k).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    lists = top.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("id"), "raw"))).alias("hits"))
    filled = queries.select(query_key).join(lists, query_key, "left").join(F.broadcast(filling))
    hits = F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType))
    spare = F.array_except("ids", F.transform(hits, lambda x: x["id"]))
    rest = F.transform(spare, lambda i: F.struct(F.lit(0).alias("rank"), i.alias("id"), F.lit(0.0).alias("raw")))
    every = F.slice(F.concat(hits, rest), 1, k)
    out = filled.select(query_key, F.posexplode(every).alias("at", "x"))
    return out.select(query_key, F.col("x.id").alias(key), F.col("x.raw").alias("raw"), (F.col("at") + 1).alias("rank"))
