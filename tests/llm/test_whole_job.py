"""Cases in which the operators once did less than the whole job."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import html_text, substring_dedup


def shared_bytes(a, b):
    """Bytes of ``b`` in passages repeated from ``a``, and the number of chunks ``a`` repeats of itself."""
    marks = []
    for text in (a.encode(), b.encode()):
        ends, numbers = substring_dedup._chunks(text)
        sizes = np.diff(ends, prepend=0).tolist()
        at, beside = [0, *ends.tolist()], [0, *sizes, 0]
        marks.append([(d, x, n, beside[k], beside[k + 2]) for k, (d, x, n) in enumerate(zip(zip(*substring_dedup._digests(text, ends, numbers), strict=True), at, sizes, strict=False))])
    seen = {m[0] for m in marks[0]}
    found = substring_dedup.passages(b.encode(), [m[1:] for m in marks[1] if m[0] in seen], substring_dedup.MIN_SPAN, substring_dedup.MIN_WORDS)
    return sum(y - x for x, y in found), len(marks[0]) - len(seen)


def random_words(rng, n, longest=9):
    return " ".join("".join(rng.choice("bcdfghjklmnpq") for _ in range(rng.randrange(2, longest))) for _ in range(n))


def test_passages_over_fifty_words_are_found_and_short_repeats_stay():
    rng = random.Random(3)
    caught = {n: 0 for n in (51, 60, 80)}
    stayed = {n: 0 for n in (10, 20, 30, 40)}
    for _ in range(400):
        for n in (*caught, *stayed):
            passage = random_words(rng, n)
            a, b = (f"{random_words(rng, 30)} {passage} {random_words(rng, 30)}" for _ in range(2))
            found = shared_bytes(a, b)[0] > 0
            if n in caught:
                caught[n] += found
            else:
                stayed[n] += not found
    assert caught[51] >= 384 and caught[60] == caught[80] == 400, caught
    # 300 unspaced letters are 600 bytes and count as 25 words.
    assert shared_bytes(f"{random_words(rng, 30)} {'é' * 300} x", f"{random_words(rng, 40)} {'é' * 300} y")[0] == 0
    assert min(stayed[n] for n in (10, 20, 30)) >= 396 and stayed[40] >= 330, stayed


@pytest.mark.parametrize("unit, times", [("no data ", 51), ("no data ", 400), ("lorem ipsum ", 300), ("yes no maybe so ", 60), ("é", 900), ("a ", 64)])
def test_short_periods_are_cut_by_content(unit, times):
    for seed in range(12):
        rng = random.Random(seed)
        head, tail, other, end = (" ".join("".join(rng.choice("bcdfghjk") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (60, 60, 47, 71))
        passage = unit * times
        shared, own = shared_bytes(f"{head} {passage}{tail}", f"{other} {passage}{end}")
        assert shared >= len(passage.encode()) - 100 and shared > 0 and own == 0


def test_parts_of_the_text_with_ambiguous_names_stay():
    own = "<h2 id='related-work'>Related work</h2><p class='notice'>Mind the step.</p><section id='discussion'><h2 id='login'>Login</h2><p>We discuss <math><mi>x</mi></math> here.</p></section>"
    other = "<div class='share'>Share this</div><div class='comments'><p>A comment.</p></div>"
    wanted = "Related work\nMind the step.\nLogin\nWe discuss x here."
    assert html_text.main_text(f"<body><article>{own}{other}</article></body>") == wanted
    assert html_text.main_text(f"<body><form><nav>Menu</nav><div>{own}</div></form></body>") == wanted
    assert html_text.main_text(f"<body><article>{own}<form>Mail <input></form></article></body>") == wanted


def test_a_text_in_two_articles_is_whole():
    first, second = ("".join(f"<p>Part {part}, paragraph {i} runs on for a while.</p>" for i in range(n)) for part, n in (("one", 3), ("two", 4)))
    wanted = "\n".join(f"Part {part}, paragraph {i} runs on for a while." for part, n in (("one", 3), ("two", 4)) for i in range(n))
    for wrap in ("%s", "<div>%s</div>"):
        html = f"<body>{wrap % f'<article>{first}</article><article>{second}</article>'}<div><a href='/'>Home</a> <a href='/x'>More</a></div></body>"
        assert html_text.main_text(html) == wanted


LONG = "".join(f"<p>Sentence {i} of the article runs on for a good while here.</p>" for i in range(5))
SHORT = "\n".join(f"Sentence {i} of the article runs on for a good while here." for i in range(5))
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/x'>More things</a></li><li><a href='/y'>And more</a></li></ul>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<form action='/'><div>{MENU}</div><div id='c'>{LONG}</div><input name='q'><button>Go</button></form>", SHORT),
        (f"<div class='page with-sidebar'><article>{LONG}</article><div class='sidebar'><p>Side words.</p></div></div><div>Copyright 2020 Example</div>", SHORT),
        (f"<div class='sidebar-page'><article>{LONG}</article><div class='sidebar'><p>Side words.</p></div></div>", SHORT),
        (f"<article>{LONG}<p title='a hidden gem' data-x='hidden'>A gem.</p><p hidden>Not seen.</p></article>", SHORT + "\nA gem."),
        (f"<article><p>Short.</p><div class='notice-of-works'>{LONG}</div></article>", "Short.\n" + SHORT),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><nav>{MENU}</nav></header>{LONG}</article>", "Title\n" + SHORT),
        (f"<main><article>{LONG}</article><article>{LONG}</article></main><div>{MENU}</div>", SHORT + "\n" + SHORT),
        (f"<div id='wrap'><div>{MENU}</div><h1>Title</h1><div id='text'>{LONG}</div><div class='comments'>{LONG * 3}</div></div>", "Title\n" + SHORT),
        (f"<div><div>{MENU}</div><div><div>{LONG}</div><div>{LONG}</div></div><div>{MENU * 4}</div></div>", SHORT + "\n" + SHORT),
        (f"<div class='related'>{MENU * 30}</div><div>{LONG}</div>", SHORT),
        (f"<article class='comment'>{LONG * 2}</article><div>{LONG}</div>", SHORT),
    ],
)
def test_density_decides_and_names_only_vote(body, text):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == text


def test_densities_equal_plain_recursion():
    """Random trees without boilerplate: counts and composite densities from the definition."""
    rng = random.Random(12)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return "w" * rng.randrange(1, 40)
        name = rng.choice(["div", "section", "div", "a", "span", "b"])
        return (name, [tree(depth - 1) for _ in range(rng.randrange(1, 4))])

    def html(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(html, node[1]))}</{node[0]}>"

    def counts(node, link=False):
        if isinstance(node, str):
            return len(node), 0, len(node) * link, 0
        parts = [counts(x, link or node[0] == "a") for x in node[1]]
        c, t, lc, lt = (sum(x) for x in zip(*parts, strict=True))
        return c, t + sum(not isinstance(x, str) for x in node[1]), lc, lt + sum(x[0] == "a" for x in node[1] if not isinstance(x, str))

    def density(node, body):
        c, t, lc, lt = counts(node, False)
        return c, t, lc, lt, body[2] / body[0]

    def walk(node, link=False):
        if not isinstance(node, str):
            yield node, link
            for x in node[1]:
                yield from walk(x, link or node[0] == "a")

    for _ in range(200):
        root = ("body", [("div", [tree(4), tree(4)]), tree(3)])
        page = html_text.Page(html(root))
        m = html_text.Measures(page, [False] * len(page.tag))
        own = list(walk(root))
        assert page.tag[1:] == [node[0] for node, _ in own]
        body = counts(root)
        expected = []
        for node, link in own:
            c, t, lc, lt = counts(node, link or node[0] == "a")
            expected.append(html_text._density(c, t, lc, lt, body[2] / max(body[0], 1)))
            tags, links, chars = max(t, 1), max(lt, 1), max(lc, 1)
            base = math.log(max(c / max(c - lc, 1) * lc + body[2] / body[0] * c + math.e, 1))
            plain = c / tags * math.log(max(c / chars * tags / links, 1 + 1e-9)) / math.log(base) if base > 1.001 else None
            assert plain is None or expected[-1] == pytest.approx(plain)
        assert m.density[1:] == pytest.approx(expected)
        sums = [sum(expected[[x is y for y, _ in own].index(True)] for x in node[1] if not isinstance(x, str)) for node, _ in own]
        assert m.total[1:] == pytest.approx(sums)


def test_pages_without_articles_and_odd_tables(spark):
    page = f"<body><div>{MENU}</div><div id='text'>{LONG}</div></body>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, f"<body><div>{LONG * 2000}</div></body>")]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.t) for r in df.select("page_id", html_text.extract(F.col("html")).alias("t")).orderBy("page_id").collect()]
    assert got == [(1, SHORT), (1, SHORT), (2, ""), (3, ""), (4, "\n".join([SHORT] * 2000))]
    assert df.limit(0).select(html_text.extract(F.col("html"))).count() == 0
