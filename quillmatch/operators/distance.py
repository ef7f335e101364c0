"""Edit distance of token sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: list, b: list) -> int:
    """Edits between two sequences, a row of the table at a time."""
    codes: dict = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a], np.int64)
    y = np.array([codes.setdefault(t, len(codes)) for t in b], np.int64)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for n, t in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        # Insertions run along the row: a running minimum less the slope.
        row = np.minimum.accumulate(np.concatenate([[n], best]) - steps) + steps
    return int(row[-1])


def token_distance(a: Column, b: Column) -> Column:
    """Distance of two token arrays, each without its last token; null arrays are empty."""
    return F.pandas_udf(_distances, "int")(a, b)


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    def cut(x) -> list:
        return [] if x is None else list(x)[:-1]

    return pd.Series([levenshtein(cut(x), cut(y)) for x, y in zip(a, b, strict=True)])
