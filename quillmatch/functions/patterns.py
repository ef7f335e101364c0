"""Patterns: token sequences with bounded wildcards.

``$SKIP<n>`` between words stands for 1 to n words.  Patterns are a bounded
catalogue that the driver holds; texts never are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillmatch.functions.text import SEPARATORS, STOP_WORDS

MAX_SKIP = 99
LARGEST_ID = 2**32 - 1
_SKIP = re.compile(r"\$skip([+]?[0-9]{1,3})")
_SPLIT = re.compile(SEPARATORS)
_UNSEEN = re.compile(r"[^\x21-\x7f]")


def words(text: str) -> list[str]:
    """The kept words of a string; the same rules as the column expressions."""
    found = _SPLIT.split(_UNSEEN.sub(" ", text.partition("\0")[0]).lower())
    bare = ((t[:-1] if t.endswith(".") else t).lstrip("+-/") for t in found)
    return [t for t in bare if re.search("[a-z0-9]", t) and t not in STOP_WORDS]


def skip_of(token: str) -> int:
    """The width of a wildcard word, or 0 for an ordinary word."""
    m = _SKIP.fullmatch(token) if 6 <= len(token) <= 8 else None
    n = int(m[1]) if m else 0
    return n if 1 <= n <= MAX_SKIP else 0


def parse_tokens(text: str) -> list[str | int]:
    """Words and wildcard widths; leading wildcards and one trailing one go."""
    out: list[str | int] = [skip_of(t) or t for t in words(text)]
    while out and isinstance(out[0], int):
        out.pop(0)
    if out and isinstance(out[-1], int):
        out.pop()
    return out


def checked_id(pattern_id: int) -> int:
    if not isinstance(pattern_id, int) or isinstance(pattern_id, bool) or not 1 <= pattern_id <= LARGEST_ID:
        raise ValueError(f"pattern id {pattern_id!r} is outside 1..{LARGEST_ID}")
    return pattern_id


@dataclass(frozen=True)
class Piece:
    """A run of words and how many words may stand before it."""

    words: tuple[str, ...]
    least: int
    most: int


@dataclass(frozen=True)
class Pattern:
    pattern_id: int
    tokens: tuple

    @classmethod
    def of(cls, pattern_id: int, tokens: list[str | int]) -> Pattern:
        checked_id(pattern_id)
        if tokens and (isinstance(tokens[0], int) or isinstance(tokens[-1], int)):
            raise ValueError(f"pattern {pattern_id} begins or ends with a wildcard")
        return cls(pattern_id, tuple(tokens))

    @property
    def pieces(self) -> list[Piece]:
        out: list[Piece] = []
        run: list[str] = []
        least = most = 0
        for t in self.tokens:
            if isinstance(t, int):
                if run:
                    out.append(Piece(tuple(run), least, most))
                    run, least, most = [], 0, 0
                least, most = least + 1, most + t
            else:
                run.append(t)
        if run:
            out.append(Piece(tuple(run), least, most))
        return out

    @property
    def span(self) -> int:
        """Most tokens a match can cover."""
        return sum(t if isinstance(t, int) else 1 for t in self.tokens)


def parse_patterns(rows: list[tuple[int, str]]) -> list[Pattern]:
    """Parsed rows (id, text); those without any word are dropped."""
    parsed = ((i, parse_tokens(text)) for i, text in rows)
    return [Pattern.of(i, tokens) for i, tokens in parsed if tokens]


def collapsed(patterns: list[Pattern]) -> list[Pattern]:
    """One pattern per token sequence of a segment: the last one added."""
    return list({p.tokens: p for p in patterns}.values())
