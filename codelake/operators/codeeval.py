"""Code evaluation.

Text work is row-local, without a shuffle, and native (regex and higher-order
functions) but for F19, a scan of tokens over Arrow batches
(``functions.declarations``).  Brace matching (F17) is one ``aggregate`` pass
over the pieces between braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.declarations import canonicalize_locals  # noqa: F401
from codelake.functions.once import let
from codelake.functions.text import WS, pyrstrip, pystrip
from codelake.operators.lineindex import line_starts, offset_of
from codelake.operators.ordering import global_index
from codelake.sources.commit import read_once, write_once

# Patterns (fixed values; Java syntax).  (?U): Unicode \b and \w, as Python's re.
NS_PREFIX = r"(?U)\bamrex::"
INCLUDE = r"#include\s*<[^>]+>"
SIGNATURE = r"(?U)\b\w+::\w+\s*\([^)]*\)\s*\{"
MACROS = (r"(?U)\bAMREX_GPU_DEVICE\b", r"(?U)\bAMREX_FORCE_INLINE\b")
PUNCT = r"([{}();,+\-*/=])"
# F25 / F26 / P9 (fixed values).
FIELD_BINDING = r'Binding for "f":\s*\n([^\n]+)'
FIELD_DECL = r"^<FieldDecl[^>]*>\s*"
SPAN = r"<(.+?):(\d+):(\d+),\s*line:(\d+):(\d+)>"
FLAG_PREFIXES = ("-I", "-D", "-std=")
FLAG_EXACT = ("-fopenmp",)
# Shell words and their pieces: quoted text, escaped characters, other text.
SHELL_PIECE = r"""'[^']*'|"(?:[^"\\]|\\.)*"|(?:[^\s"'\\]|\\.)+"""
SHELL_WORD = f"(?:{SHELL_PIECE})+"
# F21 conflict markers (ours).
CONFLICT_OPEN = "<<<<<<< CURRENT CODE\n"
CONFLICT_MID = "=======\n<<<<<<< GENERATED CODE\n"
CONFLICT_CLOSE = ">>>>>>> GENERATED\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _without(code: Column, pattern: str, word: str) -> Column:
    """``code`` without what the pattern matches; texts that do not hold the pattern's fixed ``word`` are not searched."""
    return F.when(F.contains(code, F.lit(word)), F.regexp_replace(code, pattern, "")).otherwise(code)


def clean_function(code) -> Column:
    """the first ``Class::name(args) {`` .. matching ``}``, blanks collapsed.

    No signature, or no matching brace: the stripped input (no collapsing).
    The return type before the signature is cut off, as in the reference.
    Each step is a value of its own (``let``), so a text is searched once a step.
    """
    def found(c: Column) -> Column:
        head = F.when(F.contains(c, F.lit("::")), F.regexp_extract(c, SIGNATURE, 0)).otherwise(F.lit(""))
        return let(head, lambda h: F.when(h == "", pystrip(c)).otherwise(let(F.instr(c, h), lambda start: cut(c, start, F.length(h)))))

    def cut(c: Column, start: Column, size: Column) -> Column:
        # pieces that begin with a brace each; end: the length up to the brace that closes the first, 0 if none does
        acc0 = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("end"))
        walk = F.aggregate(
            F.split(F.substring(c, start + size - 1, F.lit(1 << 30)), r"(?=[{}])", -1), acc0,
            lambda a, p: F.when(a["end"] > 0, a).otherwise(let(
                a["d"] + F.when(F.startswith(p, F.lit("{")), 1).otherwise(-1), lambda d: F.struct(
                    d.alias("d"), (a["n"] + F.length(p)).alias("n"), F.when(d == 0, a["n"] + 1).otherwise(F.lit(0)).alias("end")))),
            lambda a: a["end"])
        # runs of one blank stay as they are: only others are replaced
        blanks = lambda fn: F.regexp_replace(F.regexp_replace(fn, r"[ \t]{2,}|\t", " "), r" ?\n", "\n")
        return let(walk, lambda end: F.when(end == 0, pystrip(c)).otherwise(
            pystrip(blanks(F.substring(c, start, size - 1 + end)))))

    return let(_c(code), lambda t: let(_without(t, NS_PREFIX, "amrex::"), lambda u: let(_without(u, INCLUDE, "#include"), found)))


def normalize_code(code) -> Column:
    """drop namespace and two macros, space out punctuation, collapse whitespace."""
    def rest(c: Column) -> Column:
        return pystrip(F.regexp_replace(F.regexp_replace(c, PUNCT, " $1 "), WS + "+", " "))

    for pattern, word in reversed([(NS_PREFIX, "amrex::"), (MACROS[0], "AMREX_GPU_DEVICE"), (MACROS[1], "AMREX_FORCE_INLINE")]):
        rest = (lambda use, p, w: lambda c: let(_without(c, p, w), use))(rest, pattern, word)
    return let(_c(code), rest)


def conflict_patch(code, start, end, new) -> Column:
    """replace ``[start, end)`` (0-based) by a conflict block; both sides right-stripped."""
    code, start, end, new = _c(code), _c(start), _c(end), _c(new)
    orig = F.substring(code, start + 1, F.greatest(end - start, F.lit(0)))
    block = F.concat(F.lit(CONFLICT_OPEN), pyrstrip(orig), F.lit("\n" + CONFLICT_MID),
                     pyrstrip(new), F.lit("\n" + CONFLICT_CLOSE))
    return F.concat(F.substring(code, 1, start), block, F.substring(code, end + 1, 1 << 30))


def ast_fields(dump) -> Column:
    """the member declarations bound to ``f`` in an AST-query dump."""
    raw = F.regexp_extract_all(_c(dump), F.lit(FIELD_BINDING), 1)
    return F.transform(raw, lambda f: F.concat(
        F.regexp_replace(F.regexp_replace(pystrip(F.regexp_replace(f, FIELD_DECL, "")), ";+$", ""),
                         WS + "+", " "), F.lit(";")))


def ast_span(dump) -> Column:
    """the first ``<file:l:c, line:l:c>`` as a struct, or null."""
    d = _c(dump)
    hit = F.regexp_instr(d, F.lit(SPAN)) > 0
    return F.when(hit, F.struct(
        F.regexp_extract(d, SPAN, 1).alias("file"),
        F.regexp_extract(d, SPAN, 2).cast("int").alias("start_line"),
        F.regexp_extract(d, SPAN, 3).cast("int").alias("start_col"),
        F.regexp_extract(d, SPAN, 4).cast("int").alias("end_line"),
        F.regexp_extract(d, SPAN, 5).cast("int").alias("end_col")))


def line_start_offset(text, line) -> Column:
    """W5 row-local: offset of 1-based ``line`` in ``text`` (``splitlines(keepends)``
    lengths); null past the end, where the reference raises."""
    return offset_of(line_starts(text), line)


def compile_flags(command) -> Column:
    """Tokens starting ``-I``, ``-D``, ``-std=`` or equal to ``-fopenmp``, in order.

    Shell words: quotes group and go away; outside quotes a backslash keeps
    the next character, inside double quotes only before ``"`` and ``\\``."""
    word, piece = F.lit(SHELL_WORD), F.lit(SHELL_PIECE)

    def plain(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(F.startswith(p, F.lit("'")), inner) \
            .when(F.startswith(p, F.lit('"')), F.regexp_replace(inner, r'\\(["\\])', "$1")) \
            .otherwise(F.regexp_replace(p, r"\\(.)", "$1"))

    toks = F.regexp_extract_all(_c(command), word, 0)
    toks = F.transform(toks, lambda t: F.array_join(F.transform(F.regexp_extract_all(t, piece, 0), plain), ""))

    def keep(t):
        out = F.lit(False)
        for p in FLAG_PREFIXES:
            out = out | F.startswith(t, F.lit(p))
        for e in FLAG_EXACT:
            out = out | (t == e)
        return out

    return F.filter(toks, keep)


def flags_for_file(files: DataFrame, entries: DataFrame, file_col: str = "file") -> DataFrame:
    """The first compile entry of each file (entries carry ``pos``); files
    without an entry raise, as the reference does."""
    first = entries.groupBy(file_col).agg(F.min_by(F.col("command"), F.col("pos")).alias("command"))
    j = files.join(first, file_col, "left")
    return j.withColumn("flags", F.when(F.col("command").isNull(),
                                        F.raise_error(F.concat(F.lit("no compile entry for "), F.col(file_col))))
                        .otherwise(compile_flags(F.col("command"))))


def pair_eval(prompts: DataFrame, benchmarks: DataFrame, *, order: list[str], bench_key: str = "item_id",
              on_missing: str = "raise") -> DataFrame:
    """J2 + W6: prompt at 0-based position ``idx`` (in ``order``; empty prompts
    skipped after numbering) pairs with benchmark ``idx``.  A missing
    benchmark aborts the run (``on_missing="raise"``) or yields null."""
    p = global_index(prompts, order, "idx").filter(F.col("prompt") != "")
    j = p.join(benchmarks.withColumnRenamed(bench_key, "idx"), "idx", "left")
    if on_missing == "raise":
        j = j.withColumn("bench", F.when(F.col("bench").isNull(), F.raise_error(
            F.format_string("benchmark file not found: benchmark_%02d.txt", F.col("idx")))).otherwise(F.col("bench")))
    return j


# S9 report layout (ours): a section per text, headed by its name.
REPORT_SECTIONS = ("generated, as received", "generated, function", "generated, normalised",
                   "benchmark, as stored", "benchmark, function", "benchmark, normalised")


def section_head(name: str) -> str:
    return f"## {name}\n"


def report_text(gen_raw, gen_final, gen_norm, bench_raw, bench_final, bench_norm, cos) -> Column:
    """The per-item evaluation report."""
    parts: list[Column] = []
    for name, text in zip(REPORT_SECTIONS, (gen_raw, gen_final, gen_norm, bench_raw, bench_final, bench_norm)):
        parts += [F.lit(section_head(name)), _c(text), F.lit("\n")]
    return F.concat(*parts, F.format_string("Cosine similarity: %.4f\n", _c(cos)))


def write_eval_report(df: DataFrame, path: str) -> None:
    """S9 writer: one text file per item, partitioned by ``idx``.

    The text writer ends every row with a newline, so the report's own last
    newline is dropped first: each file holds exactly the report."""
    value = F.regexp_replace(F.col("report"), "\n$", "")
    df.select("idx", value.alias("value")).write.mode("overwrite").partitionBy("idx").text(path)


def publish_eval_reports(df: DataFrame, path: str) -> bool:
    """S9 for a whole run: ``(idx, report)`` published at once, by one writer; says whether it was this one."""
    return write_once(df.select("idx", "report"), path, "parquet")


def read_eval_reports(spark: SparkSession, path: str) -> DataFrame | None:
    """The published reports, or null."""
    return read_once(spark, path, "parquet", "idx bigint, report string")
