"""Line dedup by site-relative frequency (operator 1), in SQL functions only.

A page's visible lines are counted once per page and host; a line on more than
``MAX_RATIO`` of a host's pages (and on ``MIN_PAGES`` pages at least) is
boilerplate of that host and is dropped from every page of it.

Lines are counted by their MD5, never by their text, with partial sums before
the shuffle.  A host has at most (lines per page) / ``MAX_RATIO`` boilerplate
lines, since every page holds its share of them, so they fit one array per
host.  The boilerplate lines are written down and counted: up to
``BROADCAST_ROWS`` of them are broadcast, and no page is shuffled; beyond that
pages meet their host's array in an equi-join that Spark splits where a host
is hot.

Defined cases: a null page has no lines and an empty text; a null URL or one
without a host belongs to the host ''; blank lines never count and are
dropped; a line that repeats within a page counts once but goes everywhere; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import BROADCAST_ROWS, pinned

MAX_RATIO = 0.1
MIN_PAGES = 3

#: What never shows, what ends a line, and what is left of the markup.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
MARKUP = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The visible lines of a page: split at block tags and line feeds, blanks run together."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, ""), BREAKS, "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.regexp_replace(text, MARKUP, "") if name == "&nbsp;" else text
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.split(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def drop_lines(pages: DataFrame, host: Column, lines: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``__host``, ``__lines`` (all) and ``__kept`` (those that are no boilerplate)."""
    rows = pages.withColumns({"__host": host, "__lines": lines})
    each = rows.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: F.md5(x.cast("binary"))))).alias("__line"))
    often = each.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_pages)
    totals = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    common = pinned(often.join(totals, "__host").filter(F.col("__n") > F.lit(max_ratio) * F.col("__pages")).select("__host", "__line"))
    sites = common.groupBy("__host").agg(F.collect_list("__line").alias("__common")).withColumnRenamed("__host", "__site")
    few = common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(sites) if few else sites, F.col("__host") == F.col("__site"), "left")
    known = F.coalesce("__common", F.array().cast("array<string>"))
    kept = F.filter("__lines", lambda x: ~F.array_contains(known, F.md5(x.cast("binary"))))
    return met.withColumn("__kept", kept).drop("__site", "__common")


def clean_pages(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, host, n_lines, n_dropped, text): every page without its host's boilerplate."""
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("u"), F.col(f"`{html_col}`").alias("h"))
    done = drop_lines(slim, host_of(F.col("u")), lines_of(F.col("h")), max_ratio, min_pages)
    counts = [F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped")]
    return done.select("page_id", F.col("__host").alias("host"), *counts, F.array_join("__kept", "\n").alias("text"))
