"""Language ID by string kernels (operator 10).

The kernel of two texts is the number of character n-grams, of all lengths
from 1 to 3, that both contain (a blended-spectrum presence kernel), divided
by the geometric mean of the two numbers of n-grams.  A bounded sample of
labelled rows trains one-versus-rest kernel ridge regression in the Nystrom
space of landmark texts.  Since the kernel is a product of presence vectors,
landmarks and coefficients fold into one weight for each n-gram and language,
so a batch of texts is scored by one matrix product of its presence matrix.
An n-gram is the number its code points spell (all but letters are one
symbol), so none are merged and every n-gram of every landmark has a weight.

Bounds (parameters), on training rows only: ``ROWS_PER_LANGUAGE`` rows for each
language, of ``LONGEST_TRAINING_TEXT`` characters at most, or where a language
has no such row its ``SHORTEST_ROWS`` shortest ones; ``LANDMARKS`` landmarks of
each language.  The model has a column for each language, so more than
``MAX_LANGUAGES`` different labels raise an error.  Texts to predict are scored
whole, whatever their length.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
row without a label or text never trains; without any training row every text
is ``und``; with one language every text with a letter has it; of languages
that tie the first by name is taken; rows that repeat train as often; columns
of the table that have the new names are kept beside the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import positional

ROWS_PER_LANGUAGE = 400
LONGEST_TRAINING_TEXT = 20_000
SHORTEST_ROWS = 8
#: Landmark texts of each language.
LANDMARKS = 40
MAX_LANGUAGES = 2000
RIDGE = 1e-2
#: Softness of the score: a lead of this much in kernel units is about 73 %.
SOFTNESS = 0.12
UNKNOWN = "und"
#: What all characters but letters count as; 0 pads short n-grams.
_OTHER = 1
#: Characters that a worker holds at once, of one text or of several.
CHARS_AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 64
#: Cells of the presence matrices that training holds at once.
_CELLS_AT_ONCE = 1 << 24


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def ngrams(points: np.ndarray) -> np.ndarray:
    """The different n-grams of a text, sorted: 21 bits for each character."""
    found = []
    for start in range(0, len(points), CHARS_AT_ONCE):
        part = points[max(0, start - 2) : start + CHARS_AT_ONCE]
        ids = np.where(_letters()[part], part, _OTHER).astype(np.int64)
        pairs = (ids[:-1] << 21) | ids[1:]
        codes = np.concatenate([ids, pairs, (ids[:-2] << 42) | pairs[1:]])
        codes.sort()
        found.append(codes[np.concatenate([[True], codes[1:] != codes[:-1]])])
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    features: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-gram x language

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Places among the features of those sorted n-grams that are features."""
        at = np.minimum(np.searchsorted(self.features, codes), len(self.features) - 1)
        return at[self.features[at] == codes]

    def values(self, grams: list[np.ndarray]) -> np.ndarray:
        """The regression's values, text by language, for the n-grams of some texts."""
        hits = [self.known(codes) for codes in grams]
        columns, place = np.unique(np.concatenate(hits), return_inverse=True)
        seen = np.zeros((len(grams), len(columns)), np.float32)
        seen[np.repeat(np.arange(len(grams)), [len(h) for h in hits]), place] = 1
        return (seen @ self.weights[columns]) / np.sqrt(np.array([max(len(c), 1) for c in grams], np.float32))[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        points = {i: code_points(t) for i, t in enumerate(texts) if t}
        letters = _letters()
        rows = [i for i, p in points.items() if self.languages and letters[p].any()]
        if not rows:
            return out
        values = self.values([ngrams(points[i]) for i in rows])
        odds = np.exp((values - values.max(1, keepdims=True)) / SOFTNESS)
        for i, value, odd in zip(rows, values, odds, strict=True):
            best = int(value.argmax())
            out[i] = (self.languages[best], float(odd[best] / odd.sum()))
        return out


def _overlaps(hits: list[np.ndarray], marks: list[int], width: int) -> np.ndarray:
    """How many features each row shares with each landmark, by blocks of matrix products."""
    out = np.zeros((len(hits), len(marks)))
    rows = 256
    step = max(1, _CELLS_AT_ONCE // max(len(marks), rows))

    def dense(some: list[np.ndarray], start: int) -> np.ndarray:
        cells = np.zeros((len(some), min(step, width - start)), np.float32)
        for row, own in zip(cells, some, strict=True):
            a, b = np.searchsorted(own, (start, start + step))
            row[own[a:b] - start] = 1
        return cells

    for start in range(0, width, step):
        of_marks = dense([hits[i] for i in marks], start)
        for top in range(0, len(hits), rows):
            out[top : top + rows] += dense(hits[top : top + rows], start) @ of_marks.T
    return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on (text, language) rows, which are all in memory here.

    The first ``landmarks`` rows of each language are its landmarks.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    grams = [ngrams(code_points(t)) for t, _ in rows]
    place: dict[str, int] = {}
    marks = []
    for i, (_, lang) in enumerate(rows):
        place[lang] = place.get(lang, 0) + 1
        if place[lang] <= landmarks:
            marks.append(i)
    features = np.unique(np.concatenate([grams[i] for i in marks]))
    model = Model(languages, features, np.zeros((len(features), len(languages)), np.float32))
    hits = [model.known(codes) for codes in grams]
    sizes = np.sqrt(np.array([len(codes) for codes in grams], float))
    to_marks = _overlaps(hits, marks, len(features)) / sizes[:, None] / sizes[marks][None, :]
    among = to_marks[marks]
    # Nystrom: whiten the landmarks, then ridge regression in that space.
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8 * max(values.max(), 1e-12)
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = to_marks @ whiten
    goal = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    counts = np.array([place[lang] for _, lang in rows], float)
    each = (len(rows) / (len(languages) * counts))[:, None]  # every language counts alike
    gram = mapped.T @ (mapped * each) + ridge * len(rows) * np.eye(mapped.shape[1])
    coefficients = whiten @ np.linalg.solve(gram, mapped.T @ (goal * each))
    weights = np.zeros((len(features), len(languages)))
    for i, own in zip(marks, coefficients, strict=True):
        weights[hits[i]] += own / sizes[i]
    model.weights = weights.astype(np.float32)
    return model


def train(labelled: DataFrame, text: Column, lang: Column, key: Column, rows_per_language: int = ROWS_PER_LANGUAGE, longest: int = LONGEST_TRAINING_TEXT, landmarks: int = LANDMARKS) -> Model:
    """Fit on the rows of each language whose hash of ``key`` is smallest.

    Rows per language are counted first (a number for each language comes to
    the driver, as the model has a column for each), so only about twice as
    many rows as needed leave the scan, however large a language is.  Of a
    language whose rows are all longer than ``longest`` the shortest are taken.
    """
    rows = labelled.select(text.alias("text"), lang.alias("lang"), F.xxhash64(F.lit("langid"), key).alias("at"))
    rows = rows.filter("lang is not null and text is not null and text <> ''").withColumn("size", F.length("text"))
    counted = rows.groupBy("lang").agg(F.sum((F.col("size") <= longest).cast("long")).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels are no set of languages")
    counts = {r["lang"]: r["n"] for r in counted}
    if not counts:
        return fit([])
    shares = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, (2.0 * rows_per_language + 50) / max(n, 1)))])
    near = rows.filter(((F.shiftrightunsigned("at", 11) / float(1 << 53)) < F.element_at(shares, F.col("lang"))) & (F.col("size") <= longest))
    nearest = Window.partitionBy("lang").orderBy("at", F.xxhash64("text"))
    chosen = near.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= rows_per_language)
    got = [(r["lang"], r["nth"], r["text"]) for r in chosen.select("lang", "nth", "text").collect()]
    unseen = [name for name, n in counts.items() if not n]
    if unseen:
        shortest = Window.partitionBy("lang").orderBy("size", "at")
        least = rows.filter(F.col("lang").isin(unseen)).withColumn("nth", F.row_number().over(shortest)).filter(F.col("nth") <= SHORTEST_ROWS)
        got += [(r["lang"], r["nth"], r["text"]) for r in least.select("lang", "nth", "text").collect()]
    return fit([(text, lang) for lang, _, text in sorted(got)], landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            out, held, chars = [], [], 0
            for text in texts:
                held.append(text)
                chars += len(text or "")
                if chars >= CHARS_AT_ONCE or len(held) >= TEXTS_AT_ONCE:
                    out += own.predict(held)
                    held, chars = [], 0
            out += own.predict(held)
            yield pd.DataFrame(out, columns=["lang", "score"])

    # The types are given as objects: annotations are strings in this module.
    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(scored, "lang string, score double")
    rows, (text,) = positional(docs, text_col)
    both = rows.withColumn("__found", scored(F.col(text)))
    return both.select(*rows.columns, "__found.lang", "__found.score").toDF(*docs.columns, lang_col, score_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows whose language is known, with their own columns only.

    Where no language could be learned, rows with a letter are kept.
    """
    if not model.languages:
        return docs.filter(F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    rows, (text,) = positional(docs, text_col)
    found = identify(rows, model, text, "__lang", "__score")
    return found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(rows.columns).toDF(*docs.columns)
