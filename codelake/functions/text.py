"""Native string helpers that reproduce Python's ``str`` semantics.

Spark's ``trim`` strips spaces only; Python's ``strip()`` strips every
whitespace character.  The class below is Python's ``str.isspace`` set,
written with ``\\x{..}`` escapes that Java regex and RE2 both read, so the
same pattern serves the Spark code and the DuckDB oracle text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() characters (fixed values).
WS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Python str.splitlines() boundaries (fixed values).
LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# The same set as literal characters, for trim(str, chars) (fixed values).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

STRIP_RE = f"^{WS}+|{WS}+$"
LSTRIP_RE = f"^{WS}+"
RSTRIP_RE = f"{WS}+$"

# Characters fed to the embedder at most (fixed value).
MAX_EMBED_CHARS = 3000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x) -> Column:
    """``str.strip()``: native trim with Python's whitespace set."""
    return F.trim(_c(x), F.lit(WS_CHARS))


def pylstrip(x) -> Column:
    return F.ltrim(_c(x), F.lit(WS_CHARS))


def pyrstrip(x) -> Column:
    return F.rtrim(_c(x), F.lit(WS_CHARS))


def splitlines(x) -> Column:
    """``str.splitlines()`` as ``array<string>``: no trailing empty element."""
    parts = F.split(_c(x), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == F.lit(""),
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_widths(x) -> Column:
    """The length of each ``str.splitlines(keepends=True)`` line, as ``array<bigint>``."""
    both = F.arrays_zip(F.split(_c(x), LINE_BREAK, -1).alias("l"), F.regexp_extract_all(_c(x), F.lit(LINE_BREAK), 0).alias("b"))
    # the piece after the last break is a line only if it holds something
    lines = F.filter(both, lambda p: (p["l"] != "") | p["b"].isNotNull())
    return F.transform(lines, lambda p: (F.length(p["l"]) + F.coalesce(F.length(p["b"]), F.lit(0))).cast("bigint"))


def clip_text(x, n: int = MAX_EMBED_CHARS) -> Column:
    """strip, then keep the first ``n`` characters."""
    return F.substring(pystrip(x), 1, n)


def leading_ws(x) -> Column:
    """Leading spaces and tabs of a line (textwrap's notion of indent)."""
    return F.regexp_extract(_c(x), r"^([ \t]*)", 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings.

    Written without capturing ``a`` or ``b`` inside a lambda: the two
    character arrays are zipped first, so each string is evaluated once.
    """
    z = F.arrays_zip(F.split(a, "", -1).alias("x"), F.split(b, "", -1).alias("y"))
    # zip pads the shorter side with nulls: those positions compare as false
    same = F.transform(z, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    mism = F.array_position(same, F.lit(False))
    n = F.least(F.length(a), F.length(b))
    keep = F.when(mism == 0, n).otherwise(F.least(mism - 1, n))
    return F.substring(a, 1, keep)


def with_each(arr: Column, value: Column) -> Column:
    """``arr`` zipped with ``value`` repeated: lambdas then read ``s.v`` per
    element instead of re-evaluating ``value`` for every element."""
    return F.arrays_zip(arr.alias("e"), F.array_repeat(value, F.size(arr)).alias("v"))


def dedent_lines(lines: Column) -> Column:
    """``textwrap.dedent`` over an array of lines, returns array of lines.

    Whitespace-only lines become empty; the margin is the common prefix of
    the indents of the other lines (tabs and spaces are distinct).  The
    common prefix of a set equals that of its lexicographic min and max.
    """
    norm = F.transform(lines, lambda l: F.when(l.rlike(r"^[ \t]+$"), F.lit("")).otherwise(l))
    indents = F.transform(F.filter(norm, lambda l: l != F.lit("")), leading_ws)
    margin = F.coalesce(common_prefix(F.array_min(indents), F.array_max(indents)), F.lit(""))
    return F.transform(
        with_each(norm, margin),
        lambda s: F.when((F.length(s["v"]) > 0) & s["e"].startswith(s["v"]),
                         F.substring(s["e"], F.length(s["v"]) + 1, 1 << 30)).otherwise(s["e"]))


def dedent(text) -> Column:
    """``textwrap.dedent`` of a whole string."""
    return F.array_join(dedent_lines(F.split(_c(text), "\n", -1)), "\n")
