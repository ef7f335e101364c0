"""DuckDB SQL that several queries share."""

from __future__ import annotations

from quillmatch.functions.text import CHUNK_BYTES, SEPARATORS, STOP_WORDS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    """List of kept words of one line."""
    parts = f"string_split_regex(lower(regexp_replace({text}, '[^\\x21-\\x7f]', ' ', 'g')), {quoted(SEPARATORS)})"
    bare = f"list_transform({parts}, lambda t: ltrim(CASE WHEN t LIKE '%.' THEN left(t, len(t) - 1) ELSE t END, '+-/'))"
    return f"list_filter({bare}, lambda t: regexp_matches(t, '[a-z0-9]') AND t NOT IN ({', '.join(map(quoted, STOP_WORDS))}))"


def chunks(text: str) -> str:
    """List of a line's chunks; beyond ASCII every byte of a character is a blank."""
    bare = f"regexp_replace(regexp_replace(regexp_replace({text}, '[\\x{{80}}-\\x{{7ff}}]', '  ', 'g'), '[\\x{{800}}-\\x{{ffff}}]', '   ', 'g'), '[\\x{{10000}}-\\x{{10ffff}}]', '    ', 'g')"
    return f"list_transform(range(0, greatest(len({bare}), 1), {CHUNK_BYTES}), lambda i: substr({bare}, i + 1, {CHUNK_BYTES}))"


def tokens(table: str, key: str, text: str, chunked: bool = False) -> str:
    """CTEs ``lines`` (key, line, text) and ``tok`` (key, line, pos, token)."""
    found = f"flatten(list_transform({chunks('text')}, lambda c: {words('c')}))" if chunked else words("text")
    return f"""
        lines AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS text, generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM {table}),
        found AS (SELECT {key}, line, {found} AS w FROM lines),
        flat AS (SELECT {key}, line, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM found),
        tok AS (SELECT {key}, line, row_number() OVER (PARTITION BY {key} ORDER BY line, k) - 1 AS pos, token FROM flat)"""


def pieces(patterns: list[tuple[int, list[tuple[str, int, int]]]]) -> str:
    """CTE ``piece`` (pattern_id, n, at, words, least, most) of patterns (id, [(words, least, most), ...])."""
    rows = [
        f"({i}::BIGINT, {len(parts)}, {at}, [{', '.join(map(quoted, run.split()))}], {least}, {most})"
        for i, parts in patterns
        for at, (run, least, most) in enumerate(parts)
    ]
    return f"piece(pattern_id, n, nth, words, least, most) AS (VALUES {', '.join(rows)})"


def raw_matches(table: str, key: str, text: str, patterns: list[tuple[int, list]] | str) -> str:
    """CTE ``raw`` (key, start, matched, pattern_id, start_line, end_line); patterns as rows or as CTEs up to ``piece``."""
    return f"""RECURSIVE {tokens(table, key, text, True)},
        {patterns if isinstance(patterns, str) else pieces(patterns)},
        docs AS (SELECT {key}, list(token ORDER BY pos) AS toks, list(line ORDER BY pos) AS nums FROM tok GROUP BY {key}),
        hit AS (
            SELECT t.{key}, p.pattern_id, p.n, p.nth, p.least, p.most, t.pos AS b, t.pos + len(p.words) AS e
            FROM tok t JOIN piece p ON t.token = p.words[1] JOIN docs d ON d.{key} = t.{key}
            WHERE list_slice(d.toks, t.pos + 1, t.pos + len(p.words)) = p.words),
        chain AS (
            SELECT {key}, pattern_id, n, nth, b AS start, e FROM hit WHERE nth = 0
            UNION
            SELECT c.{key}, c.pattern_id, c.n, h.nth, c.start, h.e
            FROM chain c JOIN hit h ON h.{key} = c.{key} AND h.pattern_id = c.pattern_id AND h.nth = c.nth + 1 AND h.b - c.e BETWEEN h.least AND h.most),
        raw AS (
            SELECT c.{key}, c.start, c.e - c.start AS matched, c.pattern_id, d.nums[c.start + 1] AS start_line, d.nums[c.e] AS end_line
            FROM chain c JOIN docs d USING ({key}) WHERE c.nth = c.n - 1)"""


def resolved(key: str) -> str:
    """CTE ``best`` (key, ord, pattern_id, start_line, end_line) from ``raw``."""
    return f"""
        sorted AS (
            SELECT {key}, list([{{'s': start, 'm': matched, 'p': pattern_id, 'a': start_line, 'z': end_line}}] ORDER BY matched DESC, pattern_id DESC, start) AS xs
            FROM raw GROUP BY {key}),
        kept AS (
            SELECT {key}, list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].s < y.s + y.m AND y.s < x[1].s + x[1].m)) > 0 THEN acc ELSE list_concat(acc, x) END) AS ks
            FROM sorted),
        best AS (SELECT {key}, unnest(ks).p AS pattern_id, unnest(ks).a AS start_line, unnest(ks).z AS end_line, generate_subscripts(ks, 1) AS ord FROM kept)"""
