"""DuckDB text for the oracle queries: the same rules as the Column helpers."""

from __future__ import annotations

from codelake.functions.text import LINE_BREAK, WS, WS_CHARS


WS_CHARS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def strip(e: str) -> str:
    """Python ``str.strip()``."""
    return f"trim({e}, {WS_CHARS_SQL})"


def rstrip(e: str) -> str:
    return f"rtrim({e}, {WS_CHARS_SQL})"


def splitlines(e: str) -> str:
    """Python ``str.splitlines()`` as a list."""
    parts = f"regexp_split_to_array({e}, '{LINE_BREAK}')"
    return (f"(case when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end)")


def common_prefix(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    pos = (f"list_position(list_transform(range(1, greatest({n}, 1) + 1), "
           f"lambda i: substr({a}, i, 1) = substr({b}, i, 1)), false)")
    return (f"left({a}, case when {n} = 0 then 0 when coalesce({pos}, 0) = 0 then {n} "
            f"else {pos} - 1 end)")


def dedent_list(lines: str) -> str:
    """``textwrap.dedent`` of a list of lines, as a list of lines."""
    norm = f"list_transform({lines}, lambda l: case when regexp_matches(l, '^[ \\t]+$') then '' else l end)"
    ind = (f"list_transform(list_filter({norm}, lambda l: l <> ''), "
           f"lambda l: regexp_extract(l, '^([ \\t]*)', 1))")
    margin = f"coalesce({common_prefix(f'list_min({ind})', f'list_max({ind})')}, '')"
    return (f"list_transform({norm}, lambda l: case when len({margin}) > 0 and starts_with(l, {margin}) "
            f"then substr(l, len({margin}) + 1) else l end)")


WS_SQL = WS


def hash_tokens(text: str) -> str:
    """Tokens of the native embedder: lower-cased text split on whitespace."""
    return f"list_filter(string_split_regex(lower({text}), '{WS}+'), lambda t: t <> '')"


def bucket(tok: str, dim: int) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dim})"


def sparse_hash(src: str, ids: str, text: str, dim: int) -> str:
    """The native embedder as sparse rows ``(ids, bucket, cnt)`` (blank text: no rows)."""
    return (f"(select {ids}, {bucket('t', dim)} bucket, count(*)::DOUBLE cnt from "
            f"(select {ids}, unnest({hash_tokens(text)}) t from {src}) group by all)")
