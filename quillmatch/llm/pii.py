"""Personal data by bootstrapped contextual extraction (operator 6).

Four fixed patterns give the base spans: email, ip, card and phone.  They are
seeds of a bootstrap, together with seeds of two more kinds that check
themselves: IBANs whose check digits fit, and secrets, which are published key
formats or quoted values of mixed letters and digits behind an assignment sign.

Every mention, seed or candidate of a looser shape, is an edge between an
instance (kind and normalised value) and the lexical patterns around it: the
one, two or three tokens before its slot, those after it, and the nearest ones
of both sides together.  Tokens are runs of letters, runs of digits (one slot
each, whatever the number) and single signs, so a cue glued to a value counts
as well as one apart.  In each round Spark scores a pattern by its trusted
mentions against the mentions of rival kinds in its slot and against the places
in the whole corpus where its tokens stand beside no mention; candidates of its
own kind that are not trusted yet count neither way.  A candidate has the
score of the best pattern that holds it.  Those that reach ``TRUST`` weigh in
the next round, so new values bring new patterns, until a round finds nothing
new.  All mentions of a trusted candidate are added to the base spans; common
words never become confident, since the places where they stand without
personal data count against them.

Patterns are 64-bit hashes of their tokens, whatever their length.  Values and
patterns are only ever summed, joined and filtered.  No text is shuffled:
mentions carry a row number, and their spans return to the row.

Defined cases: a null text is empty; offsets are code points, ends exclusive;
rows with equal ids are kept apart; runs of digits, letters, dots and signs of
any length take linear time; an empty table gives none; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.common import pinned

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the bootstrap reports.
FURTHER = ("iban", "secret")
ORDER = KINDS + FURTHER
#: Least score of a pattern and of an instance that are believed.
TRUST = 0.8
#: Different trusted values a pattern must be seen with.
LEAST_SUPPORT = 3
#: Patterns whose places are counted by lookup; beyond this many all places are counted.
MAX_CUES = 500_000
#: Characters of texts whose places a worker holds at once.
CHARS_AT_ONCE = 1 << 20
#: Least bits a character of an assigned secret carries.
LEAST_ENTROPY = 3.0

_AT_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_VEILED = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|@", re.I)
_VEILED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)[A-Za-z0-9-]++)*+", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ -]{1,3}[0-9]{4}){2}[./_ -]{1,3}[0-9]{1,7}(?![0-9A-Za-z])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Published formats of keys and tokens.
_KEYS = re.compile(
    r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"
)
_ASSIGNED = re.compile(r"""[=:]\s?(["'])([A-Za-z0-9+/_=-]{20,}+)\1""")
#: Runs of eight and more with a digit in them.
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{8})[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+={0,2}")
_LETTER = re.compile(r"[A-Za-z]")
_LOOSE_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the greedy pattern finds them from the left, but outward from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and _AT_LEFT.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)] + [("card", a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [("phone", a, b) for a, b in _phones(text)]
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of IBAN shape whose check digits fit, cut at a blank if need be."""
    for m in _IBAN.finditer(text):
        run = m[0]
        for end in [len(run), *[k for k in range(len(run) - 1, 14, -1) if run[k] == " "]]:
            plain = run[:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1:
                yield m.start(), m.start() + end
                break


def entropy(value: str) -> float:
    """Bits a character of the value carries."""
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _KEYS.finditer(text):
        yield m.span()
    if '"' in text or "'" in text:
        for m in _ASSIGNED.finditer(text):
            if _DIGIT.search(m[2]) and _LETTER.search(m[2]) and entropy(m[2]) >= LEAST_ENTROPY:
                yield m.span(2)


class _Taken:
    """Disjoint spans that are taken."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.reach: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.starts and a < self.reach[-1]:
                self.reach[-1] = max(self.reach[-1], b)
            else:
                self.starts.append(a)
                self.reach.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes a span that touches none of the others; False if it does."""
        at = bisect_left(self.starts, b)  # spans before this one start before b
        if at and self.reach[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.reach.insert(at, b)
        return True


def further_seeds(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Seeds of the kinds beside the base ones, none of them touching a base span."""
    found = [("secret", a, b) for a, b in _secrets(text)]
    if _DIGIT.search(text):
        found = [("iban", a, b) for a, b in _ibans(text)] + found
    free = _Taken(taken)
    return [x for x in sorted(found, key=lambda x: (ORDER.index(x[0]), x[1])) if free.add(*x[1:])]


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of looser shapes that touch no span of ``taken`` and not each other."""
    found: list[tuple[str, int, int]] = []
    for m in _VEILED.finditer(text):
        start, right = m.start(), _VEILED_HOST.match(text, m.end())
        while start and _AT_LEFT.match(text[start - 1]):
            start -= 1
        if right and start < m.start():
            found.append(("email", start, right.end()))
    if _COLONS.search(text):
        found += [("ip", *m.span()) for m in _LOOSE_IP.finditer(text)]
    if _DIGIT.search(text):
        for m in _LOOSE_CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text) if 7 <= len(_DIGIT.findall(m[0])) <= 15]
        found += [("iban" if _LOOSE_IBAN.fullmatch(m[0]) else "secret", *m.span()) for m in _MIXED.finditer(text) if _LETTER.search(m[0])]
    if not found:
        return found
    free = _Taken(taken)
    return [x for x in sorted(found, key=lambda x: (ORDER.index(x[0]), x[1])) if free.add(*x[1:])]


def normal_value(kind: str, value: str) -> str:
    if kind == "secret":
        return value
    value = value.lower()
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("card", "phone"):
        return "".join(_DIGIT.findall(value))
    return re.sub(r"\s?[\[({<]\s?dot\s?[\])}>]\s?", ".", re.sub(r"\s?[\[({<]\s?at\s?[\])}>]\s?", "@", value))


@lru_cache(1 << 16)
def _token_hash(token: str) -> int:
    """A token's number, never 0; all runs of digits are one token."""
    return xxhash.xxh3_64_intdigest(("0" if token.isdecimal() else token.lower()).encode("utf-8", "surrogatepass")) or 1


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def patterns_of(left: list[np.ndarray], right: list[np.ndarray], across: np.ndarray) -> Iterator[np.ndarray]:
    """Seven patterns of each slot, from its token numbers, nearest first.

    ``across`` is the token behind the slot for the pattern of both sides.  0
    stands for tokens beyond the text's ends.
    """
    for side, tokens in ((1, left), (2, right)):
        so_far = np.zeros_like(across)
        for n, token in enumerate(tokens):
            so_far = _mixed(so_far ^ token, 10 * side + n)
            yield so_far
    yield _mixed(_mixed(left[0].copy(), 31) ^ across, 32)


def _slots(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The patterns around spans, a row for each."""
    ends = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in ends]
    near = np.zeros((6, len(spans)), np.uint64)
    for k, (_, a, b) in enumerate(spans):
        i = bisect_left(starts, a)
        for n in range(min(3, i)):  # a token that the span cuts counts by its part outside
            x, y = ends[i - 1 - n]
            near[n, k] = _token_hash(text[x : min(y, a)])
        j = bisect_right(starts, b - 1)
        cut = bool(j) and ends[j - 1][1] > b
        for n in range(3):
            at = j + n - cut
            if at < len(ends):
                near[3 + n, k] = _token_hash(text[max(starts[at], b) : ends[at][1]])
    return np.stack(list(patterns_of(list(near[:3]), list(near[3:]), near[3])), 1)


def places_of(texts: list[str]) -> Iterator[np.ndarray]:
    """The patterns of all places of some texts, an array for each of the seven sorts.

    A place lies between two tokens or at an end; for patterns of both sides
    it holds one token.
    """
    tokens: list[str] = []
    sizes = []
    for text in texts:
        found = _TOKEN.findall(text)
        sizes.append(len(found))
        tokens += found
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    known = np.array([_token_hash(t) for t in coded.dictionary.to_pylist()], np.uint64)
    of_text = np.repeat(np.arange(len(texts)), sizes)
    line = np.zeros(len(tokens) + 3 * (len(texts) + 1), np.uint64)  # three blanks around every text
    if tokens:
        line[np.arange(len(tokens)) + 3 * (of_text + 1)] = known[coded.indices.to_numpy()]
    at = np.arange(len(tokens) + len(texts)) + 2 * np.repeat(np.arange(len(texts)), np.array(sizes) + 1) + 3
    *sides, both = patterns_of([line[at - 1], line[at - 2], line[at - 3]], [line[at], line[at + 1], line[at + 2]], line[at + 1])
    yield from sides
    yield both[line[at] != 0]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MENTION = T.StructType([*_SPAN.elementType.fields, T.StructField("value", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("base", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.LongType()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its base spans and its mentions."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    mention = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))
    for batch in batches:
        bases, mentions = [], []
        for cell in batch.column(1):
            text = cell.as_py() or ""
            base = base_spans(text)
            seeds = base + further_seeds(text, base)
            spans = seeds + loose_spans(text, seeds)
            rows = []
            if spans:
                for k, ((kind, a, b), around) in enumerate(zip(spans, _slots(text, spans).view(np.int64).tolist(), strict=True)):
                    rows.append({"kind": kind, "start": a, "end": b, "value": normal_value(kind, text[a:b]), "seed": k < len(seeds), "base": k < len(base), "patterns": around})
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            mentions.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(mentions, mention)], names=["doc_id", "base", "mentions"])


def _count_places(cues):
    """Counts of the patterns ``cues`` (a broadcast sorted array), or of all patterns."""

    def out(patterns: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(patterns.view(np.int64)), pa.array(counts.astype(np.int64))], names=["pattern", "n"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        held, size = [], 0
        for batch in batches:
            for cell in batch.column(0):
                held.append(cell.as_py() or "")
                size += len(held[-1])
                if size >= CHARS_AT_ONCE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cues is None:
            for texts in groups(batches):
                for patterns in places_of(texts):
                    yield out(*np.unique(patterns, return_counts=True))
            return
        wanted = cues.value
        if not len(wanted):
            return
        bits = np.uint64((1 << (16 * len(wanted)).bit_length()) - 1)
        may = np.zeros(int(bits) + 1, bool)  # most places fail this test, so few are looked up
        may[wanted & bits] = True
        counts = np.zeros(len(wanted), np.int64)
        for texts in groups(batches):
            for patterns in places_of(texts):
                patterns = patterns[may[patterns & bits]]
                at = np.minimum(np.searchsorted(wanted, patterns), len(wanted) - 1)
                found, n = np.unique(at[wanted[at] == patterns], return_counts=True)
                counts[found] += n
        yield out(wanted[counts > 0], counts[counts > 0])

    return run


def _trusted_values(mentions: DataFrame, texts: DataFrame, trust: float, support: int) -> DataFrame:
    """Rows (kind, value) that the bootstrap believes, its seeds included."""
    spark = mentions.sparkSession
    edges = mentions.select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    edges = pinned(edges.groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    # Only patterns of enough different values can be believed in any round.
    able = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("own")).filter(F.col("values") >= support)
    held = edges.groupBy("pattern").agg(F.sum("n").alias("held"))
    able = pinned(able.join(held, "pattern").filter(F.col("own") >= F.lit(trust) * F.col("held")).select("pattern", "kind", "own", "held"))
    wanted = able.select("pattern").distinct()
    few = wanted.limit(MAX_CUES + 1).count() <= MAX_CUES
    cues = spark.sparkContext.broadcast(np.sort(np.array([r["pattern"] for r in wanted.collect()], np.int64).view(np.uint64))) if few else None
    places = texts.mapInArrow(_count_places(cues), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("places"))
    against = F.col("held") - F.col("own") + F.greatest(F.coalesce("places", F.lit(0)) - F.col("held"), F.lit(0))
    able = able.join(places, "pattern", "left").withColumn("against", against).filter(F.col("own") >= F.lit(trust) * (F.col("own") + F.col("against")))
    able = pinned(able.select("pattern", "kind", "against"))
    edges = pinned(edges.join(able, ["pattern", "kind"]))
    seeds = pinned(mentions.filter("seed").select("kind", "value").distinct().withColumn("score", F.lit(1.0)))
    trusted, known = seeds, 0
    while True:
        weighed = edges.join(trusted, ["kind", "value"])
        patterns = weighed.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("held"), F.count(F.lit(1)).alias("values"), F.max("against").alias("against"))
        patterns = patterns.withColumn("belief", F.col("held") / (F.col("held") + F.col("against"))).filter((F.col("belief") >= trust) & (F.col("values") >= support))
        new = edges.filter("not seed").join(patterns.select("pattern", "kind", "belief"), ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("belief").alias("score"))
        new = pinned(new.join(seeds.select("kind", "value"), ["kind", "value"], "left_anti"))
        count = new.count()
        trusted = seeds.unionByName(new)
        if count == known:  # beliefs only grow, so no new value means no change to come
            return trusted.select("kind", "value")
        known = count


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST, support: int = LEAST_SUPPORT) -> DataFrame:
    """Rows (doc_id, base, added): arrays of (kind, start, end) for every row of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("base", _SPAN), T.StructField("mentions", T.ArrayType(_MENTION))])
    rows = pinned(slim.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()))
    mentions = pinned(rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*"))
    believed = _trusted_values(mentions, slim.select("text"), trust, support)
    added = mentions.filter("not base").join(believed, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = rows.select("row", "doc_id", "base").join(added, "row", "left")
    return both.select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))
