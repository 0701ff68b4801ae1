"""Corpus chunking, in each file's own row or as set rules over a line table.

``chunk_cpp_files`` and ``chunk_fortran_files`` take files with their lines as
an array.  Marker blocks are found by one pattern over the joined lines, so a
file is cut in its own row: no shuffle, no window.  ``chunk_cpp`` and
``chunk_fortran`` take a line table ``(*file_keys, line_no, line)``, for
input that comes as lines, and decide by windows over the file in line order;
both forms give the same chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.once import once
from codelake.functions.text import WS, dedent_lines, pystrip, splitlines
from codelake.operators.lineindex import line_starts

# Markers and limits (fixed values).
CPP_MARKER = "// AI_METADATA"
INTENT_KEY = "user_intent:"
F_PURPOSE = "! purpose:"
F_KEYWORDS = "! keywords:"
F_CONTEXT = "! context:"
F_END = "! end code chunk"
F_PROCEDURE = "module procedure"
# Heads over lines joined by newlines: blanks within a line, a marker line with the comment
# lines after it, a purpose line; the lines of an intent block among header contents.
_BLANK = WS.replace(r"\n\x{0B}\f\r", "").replace(r"\x{1C}-\x{1F}", r"\x{1F}").replace(r"\x{85}", "").replace(r"\x{2028}\x{2029}", "")
CPP_HEAD = rf"(?md)^{_BLANK}*{CPP_MARKER}[^\n]*(?:\n{_BLANK}*//[^\n]*)*"
FORTRAN_HEAD = rf"(?mdi)^{_BLANK}*{F_PURPOSE}[^\n]*"
INTENT_BLOCK = rf"(?md)^{INTENT_KEY}[^\n]*((?:\n[^:\n]*(?=\n|\z))*)"


def explode_lines(files: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``str.splitlines()`` into ``(keep..., line_no bigint, line)``, order kept."""
    keep = keep if keep is not None else [c for c in files.columns if c != text_col]
    return (files.select(*keep, F.posexplode(splitlines(text_col)).alias("line_no", "line"))
                 .withColumn("line_no", F.col("line_no").cast("bigint")))


def file_line_offsets(files: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """W5 for whole files, in their own rows: ``(keep..., line_no, offset)``, line breaks counted as long as they are."""
    d = files.select(*keep, line_starts(text_col).alias("_starts"))
    return d.select(*keep, F.posexplode(F.slice("_starts", F.lit(1), F.size("_starts") - 1)).alias("line_no", "offset")) \
        .withColumn("line_no", F.col("line_no").cast("bigint"))


def _sorted_join(cond: Column, val: Column, sep: str = "\n") -> Column:
    """A2: ordered concatenation of the values of the rows where ``cond`` holds."""
    parts = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("line_no"), val.alias("v")))))
    return F.array_join(F.transform(parts, lambda s: s["v"]), sep)


def _sorted_list(cond: Column, val: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("line_no"), val.alias("v")))))
    return F.transform(parts, lambda s: s["v"])


def chunk_id(file_key: Column, chunk_no: Column) -> Column:
    """a stable id per chunk (the reference draws a random UUID)."""
    return F.sha2(F.concat_ws(":", file_key.cast("string"), chunk_no.cast("string")), 256)


# ---------------------------------------------------------------------- C++
def mark_cpp_lines(lines: DataFrame, file_keys: list[str]) -> DataFrame:
    """Label each line with ``chunk_no`` (0 = before the first chunk) and its role.

    Rule: within each maximal run of ``//`` lines the first marker opens a
    chunk; the rest of that run is metadata, then code runs to the next
    opening marker.
    """
    wf = Window.partitionBy(*file_keys).orderBy("line_no")
    s = pystrip(F.col("line"))
    df = (lines.withColumn("_s", s)
               .withColumn("_is_c", F.startswith(F.col("_s"), F.lit("//")))
               .withColumn("_is_m", F.startswith(F.col("_s"), F.lit(CPP_MARKER)))
               # run id: number of non-comment lines so far (a comment run shares it)
               .withColumn("_run", F.sum(F.when(F.col("_is_c"), 0).otherwise(1))
                           .over(wf.rowsBetween(Window.unboundedPreceding, 0))))
    wr = Window.partitionBy(*file_keys, "_run")
    df = df.withColumn("_open", F.col("_is_m") & F.col("_is_c") & (
        F.col("line_no") == F.min(F.when(F.col("_is_m"), F.col("line_no"))).over(wr)))
    df = df.withColumn("chunk_no", F.sum(F.col("_open").cast("int"))
                       .over(wf.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    wc = Window.partitionBy(*file_keys, "chunk_no")
    df = df.withColumn("_mrun", F.min(F.when(F.col("_open"), F.col("_run"))).over(wc))
    role = (F.when(F.col("chunk_no") == 0, F.lit("none"))
            .when(F.col("_open"), F.lit("marker"))
            .when(F.col("_run") == F.col("_mrun"), F.lit("meta"))
            .otherwise(F.lit("code")))
    return df.withColumn("role", role).drop("_is_m", "_is_c", "_mrun")


def parse_cpp_metadata(marked: DataFrame, file_keys: list[str]) -> DataFrame:
    """F2 per line of a chunk: ``content``, ``is_intent``, ``is_kv``, ``key``, ``value``.

    Only metadata lines can be intent text or key/value pairs.  A line is
    intent text iff it has no ``:`` and the latest earlier metadata line
    with a ``:`` starts ``user_intent:``; lines with a ``:`` that do not
    start ``user_intent:`` are pairs split at the first ``:``.  Metadata
    lines come right after the marker, so "earlier lines of the chunk"
    are the marker and earlier metadata lines.
    """
    is_meta = F.col("role") == "meta"
    content = F.when(is_meta, pystrip(F.ltrim(F.col("_s"), F.lit("/"))))
    m = marked.withColumn("content", content)
    has_colon = F.instr(F.col("content"), ":") > 0
    wc = (Window.partitionBy(*file_keys, "chunk_no").orderBy("line_no")
          .rowsBetween(Window.unboundedPreceding, -1))
    prev_colon = F.last(F.when(has_colon, F.col("content")), ignorenulls=True).over(wc)
    is_intent = is_meta & ~has_colon & F.coalesce(F.startswith(prev_colon, F.lit(INTENT_KEY)), F.lit(False))
    is_kv = is_meta & has_colon & ~F.startswith(F.col("content"), F.lit(INTENT_KEY))
    pos = F.instr(F.col("content"), ":")
    return (m.withColumn("is_intent", is_intent).withColumn("is_kv", is_kv)
             .withColumn("key", F.when(is_kv, pystrip(F.expr("substring(content, 1, instr(content, ':') - 1)"))))
             .withColumn("value", F.when(is_kv, pystrip(F.substring(F.col("content"), pos + 1, 1 << 30)))))


def chunk_cpp(lines: DataFrame, file_keys: list[str], fixed: dict[str, Column] | None = None) -> DataFrame:
    """W1 + F2 + A2 + A8 + F5 + P7: one row per C++ chunk.

    Columns: ``*file_keys, chunk_no, chunk_id, code (dedented), user_intent,
    metadata map<string,string>, embedding_text``.  ``fixed`` holds the fixed
    metadata entries (example, source_file, relative_path, language) as
    columns of the line table; parsed keys override them, ``user_intent``
    is always set last.

    One pass: the line windows, then a single aggregate per chunk (the
    windows already partition by file, so the aggregate adds no exchange).
    """
    fixed = fixed or {}
    marked = mark_cpp_lines(lines.select(*file_keys, "line_no", "line",
                                         *[v.alias(f"_fx_{k}") for k, v in fixed.items()]), file_keys)
    parsed = parse_cpp_metadata(marked.filter(F.col("role") != "none"), file_keys)
    g = file_keys + ["chunk_no"]
    agg = parsed.groupBy(*g).agg(
        _sorted_list(F.col("role") == "code", F.col("line")).alias("_code_lines"),
        _sorted_join(F.col("is_intent"), F.col("content")).alias("_intent"),
        _sorted_list(F.col("is_kv"), F.struct(F.col("key"), F.col("value"))).alias("_kv"),
        *[F.first(F.when(F.col("role") == "marker", F.col(f"_fx_{k}")), ignorenulls=True).alias(f"_fx_{k}")
          for k in fixed])
    kv_t = "array<struct<key:string,value:string>>"
    fixed_entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_fx_{k}").cast("string").alias("value"))
                              for k in fixed]) if fixed else F.array().cast(kv_t)
    intent = pystrip(F.col("_intent"))
    entries = F.concat(fixed_entries, F.col("_kv"),
                       F.array(F.struct(F.lit("user_intent").alias("key"), intent.alias("value"))))
    fk = F.concat_ws("/", *[F.col(k).cast("string") for k in file_keys])
    return agg.select(
        *g,
        chunk_id(fk, F.col("chunk_no")).alias("chunk_id"),
        F.array_join(dedent_lines(F.col("_code_lines")), "\n").alias("code"),
        intent.alias("user_intent"),
        F.map_from_entries(entries).alias("metadata"),
        F.concat(F.lit("USER INTENT:\n"), intent, F.lit("\n\n")).alias("embedding_text"))


def _cut(df: DataFrame, text_col: str, head: str) -> DataFrame:
    """``df`` with ``_heads``, the heads found in a text, and ``_rest``, the lines after each up to the next head."""
    text = F.col(text_col)
    df = once(df, F.regexp_extract_all(text, F.lit(head), F.lit(0)).alias("_heads"), F.split(text, head, -1).alias("_pieces"))
    n = F.size("_pieces")                            # a column: the lambda must not split the text again for each piece

    def lines(piece: Column, i: Column) -> Column:
        inner = F.when(i + 2 < n, F.substring(piece, F.lit(2), F.length(piece) - 2)).otherwise(F.substring(piece, 2, 1 << 30))
        return F.when((piece == "") | ((piece == "\n") & (i + 2 < n)), F.array().cast("array<string>")).otherwise(F.split(inner, "\n", -1))

    return once(df, F.transform(F.slice("_pieces", 2, F.greatest(n - 1, F.lit(0))), lines).alias("_rest"))


def chunk_cpp_files(files: DataFrame, file_keys: list[str], fixed: dict[str, Column] | None = None,
                    lines_col: str = "lines") -> DataFrame:
    """W1 + F2 + A2 + A8 + F5 + P7 in each file's row; the columns of ``chunk_cpp``.

    A marker line with the comment lines right after it is a chunk's head, so
    the first marker of a comment run opens a chunk and the others belong to it."""
    fixed = fixed or {}
    df = files.select(*file_keys, F.array_join(lines_col, "\n").alias("_text"),
                      *[v.cast("string").alias(f"_fx_{k}") for k, v in fixed.items()])
    df = _cut(df, "_text", CPP_HEAD)
    df = df.select(*file_keys, *[f"_fx_{k}" for k in fixed], F.posexplode(F.arrays_zip("_heads", "_rest")).alias("_i", "_c"))
    meta = F.transform(F.slice(F.split("_c._heads", "\n", -1), 2, 1 << 30), lambda l: pystrip(F.ltrim(pystrip(l), F.lit("/"))))
    df = once(df, meta.alias("_meta"))
    intent = pystrip(F.array_join(F.regexp_extract_all(F.array_join("_meta", "\n"), F.lit(INTENT_BLOCK), F.lit(1)), ""))
    pairs = F.filter("_meta", lambda c: (F.instr(c, ":") > 0) & ~F.startswith(c, F.lit(INTENT_KEY)))
    pairs = F.transform(pairs, lambda c: F.struct(pystrip(F.substring_index(c, ":", 1)).alias("key"),
                                                  pystrip(F.substring(c, F.instr(c, ":") + 1, F.length(c))).alias("value")))
    df = once(df, intent.alias("user_intent"), pairs.alias("_kv"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    own = F.array(*[entry(k, F.col(f"_fx_{k}")) for k in fixed]) if fixed else F.array().cast("array<struct<key:string,value:string>>")
    fk = F.concat_ws("/", *[F.col(k).cast("string") for k in file_keys])
    df = df.withColumn("chunk_no", (F.col("_i") + 1).cast("bigint"))
    return df.select(
        *file_keys, "chunk_no", chunk_id(fk, F.col("chunk_no")).alias("chunk_id"),
        F.array_join(dedent_lines(F.col("_c._rest")), "\n").alias("code"), "user_intent",
        F.map_from_entries(F.concat(own, F.col("_kv"), F.array(entry("user_intent", F.col("user_intent"))))).alias("metadata"),
        F.concat(F.lit("USER INTENT:\n"), F.col("user_intent"), F.lit("\n\n")).alias("embedding_text"))


# ------------------------------------------------------------------ Fortran
def chunk_fortran(lines: DataFrame, file_keys: list[str], fixed: dict[str, Column] | None = None,
                  embed_lines: int | None = None) -> DataFrame:
    """W2 + F3 + F4 + F5: one row per Fortran chunk.

    Per chunk: ``fc`` = first line not starting ``!``; ``end`` = first
    ``! end code chunk`` at or after ``fc``; header = lines before ``fc``;
    code = ``[fc, end)``.  A header ``!`` line continues the context once a
    context line was seen, else the purpose.

    ``metadata`` holds the ``fixed`` entries (columns of the line table) and the
    chunk's own (P7).  ``embed_lines`` keeps only that many code lines in the
    embedding text; by default it holds all.
    """
    fixed = fixed or {}
    lines = lines.select(*file_keys, "line_no", "line", *[v.cast("string").alias(f"_fx_{k}") for k, v in fixed.items()])
    wf = Window.partitionBy(*file_keys).orderBy("line_no")
    s = pystrip(F.col("line"))
    low = F.lower(F.col("_s"))
    df = (lines.withColumn("_s", s)
               .withColumn("_is_p", F.startswith(low, F.lit(F_PURPOSE)))
               .withColumn("chunk_no", F.sum(F.col("_is_p").cast("int"))
                           .over(wf.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
               .filter(F.col("chunk_no") > 0))
    wc = Window.partitionBy(*file_keys, "chunk_no")
    bang = F.startswith(F.col("_s"), F.lit("!"))
    df = df.withColumn("_fc", F.min(F.when(~bang, F.col("line_no"))).over(wc))
    df = df.withColumn("_end", F.min(F.when((F.lower(F.col("_s")) == F_END)
                                            & F.col("_fc").isNotNull()
                                            & (F.col("line_no") >= F.col("_fc")), F.col("line_no"))).over(wc))
    is_header = F.col("_fc").isNull() | (F.col("line_no") < F.col("_fc"))
    is_code = (~is_header) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    low = F.lower(F.col("_s"))
    is_kw = is_header & ~F.col("_is_p") & F.startswith(low, F.lit(F_KEYWORDS))
    is_ctx = is_header & ~F.col("_is_p") & ~is_kw & F.startswith(low, F.lit(F_CONTEXT))
    is_other = is_header & ~F.col("_is_p") & ~is_kw & ~is_ctx
    wrun = (Window.partitionBy(*file_keys, "chunk_no").orderBy("line_no")
            .rowsBetween(Window.unboundedPreceding, -1))
    df = (df.withColumn("_hdr", is_header).withColumn("_code", is_code)
            .withColumn("_kw", is_kw).withColumn("_ctx", is_ctx).withColumn("_oth", is_other)
            .withColumn("_ctx_seen", F.coalesce(F.max(F.col("_ctx").cast("int")).over(wrun), F.lit(0)) == 1))
    after_colon = pystrip(F.expr("substring(_s, instr(_s, ':') + 1)"))
    other_txt = pystrip(F.expr("substring(_s, 2)"))
    purpose_part = F.when(F.col("_is_p"), after_colon).when(F.col("_oth") & ~F.col("_ctx_seen"), other_txt)
    context_part = F.when(F.col("_ctx"), after_colon).when(F.col("_oth") & F.col("_ctx_seen"), other_txt)
    kws = F.filter(F.transform(F.split(after_colon_raw(), ",", -1), lambda k: pystrip(k)),
                   lambda k: k != F.lit(""))
    df = (df.withColumn("_pp", purpose_part).withColumn("_cp", context_part)
            .withColumn("_kws", F.when(F.col("_kw"), kws)))
    g = file_keys + ["chunk_no"]
    agg = df.groupBy(*g).agg(
        _sorted_join(F.col("_pp").isNotNull(), F.col("_pp"), " ").alias("purpose"),
        _sorted_join(F.col("_cp").isNotNull(), F.col("_cp"), " ").alias("context"),
        F.flatten(_sorted_list(F.col("_kws").isNotNull(), F.col("_kws"))).alias("keywords"),
        _sorted_list(F.col("_code"), F.col("line")).alias("code_lines"),
        *[F.max(f"_fx_{k}").alias(f"_fx_{k}") for k in fixed])
    proc_line = F.try_element_at(F.filter(F.col("code_lines"),
                                          lambda l: F.instr(F.lower(l), F_PROCEDURE) > 0), F.lit(1))
    proc = F.element_at(F.split(pystrip(F.replace(proc_line, F.lit("&"), F.lit(""))), WS + "+", -1), -1)
    kw_txt = F.array_join(F.col("keywords"), ", ")
    emb_text = F.concat(F.lit("PURPOSE:\n"), F.col("purpose"), F.lit("\n\nKEYWORDS:\n"), kw_txt,
                        F.lit("\n\nCONTEXT:\n"), F.col("context"), F.lit("\n\nCODE:\n"),
                        F.array_join(F.slice(F.col("code_lines"), 1, embed_lines) if embed_lines else F.col("code_lines"), "\n"))
    entries = [(k, F.col(f"_fx_{k}")) for k in fixed] + [
        ("procedure", F.coalesce(proc, F.lit(""))), ("purpose", F.col("purpose")), ("keywords", kw_txt), ("context", F.col("context"))]
    metadata = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries]))
    fk = F.concat_ws("/", *[F.col(k).cast("string") for k in file_keys])
    return agg.select(*g, chunk_id(fk, F.col("chunk_no")).alias("chunk_id"),
                      proc.alias("procedure"), "purpose", "keywords", "context",
                      F.array_join(F.col("code_lines"), "\n").alias("code"),
                      F.size("code_lines").cast("bigint").alias("n_code_lines"),
                      metadata.alias("metadata"), emb_text.alias("embedding_text"))


def chunk_fortran_files(files: DataFrame, file_keys: list[str], fixed: dict[str, Column] | None = None,
                        embed_lines: int | None = None, lines_col: str = "lines") -> DataFrame:
    """W2 + F3 + F4 + F5 + P7 in each file's row; the columns of ``chunk_fortran``.

    A purpose line is a chunk's head; the ``!`` lines right after it are its
    header, and code runs from there to an end marker or the next head."""
    fixed = fixed or {}
    df = files.select(*file_keys, F.array_join(lines_col, "\n").alias("_text"),
                      *[v.cast("string").alias(f"_fx_{k}") for k, v in fixed.items()])
    df = _cut(df, "_text", FORTRAN_HEAD)
    df = df.select(*file_keys, *[f"_fx_{k}" for k in fixed], F.posexplode(F.arrays_zip("_heads", "_rest")).alias("_i", "_c"))
    stripped = F.transform("_c._rest", lambda l: pystrip(l))
    df = once(df, stripped.alias("_s"))
    first = F.array_position(F.transform("_s", lambda l: F.startswith(l, F.lit("!"))), False).cast("int")
    df = once(df, F.when(first > 0, first - 1).otherwise(F.size("_s")).alias("_n"))       # header lines
    ends = F.array_position(F.transform(F.slice("_s", F.col("_n") + 1, F.size("_s")), lambda l: F.lower(l) == F_END), True).cast("int")
    code = F.slice("_c._rest", F.col("_n") + 1, F.when(ends > 0, ends - 1).otherwise(F.size("_s")))
    low = lambda l: F.lower(l)
    is_kw = lambda l: F.startswith(low(l), F.lit(F_KEYWORDS))
    is_ctx = lambda l: F.startswith(low(l), F.lit(F_CONTEXT))
    after = lambda l: F.substring(l, F.instr(l, ":") + 1, F.length(l))
    head = F.slice("_s", 1, F.col("_n"))
    df = once(df, code.alias("code_lines"), F.filter(head, lambda l: ~is_kw(l)).alias("_head"),
                    F.filter(head, is_kw).alias("_kw"), pystrip(after(pystrip("_c._heads"))).alias("_purpose"))
    ctx = F.array_position(F.transform("_head", is_ctx), True).cast("int")
    df = once(df, F.when(ctx > 0, ctx - 1).otherwise(F.size("_head")).alias("_ctx"))
    other = lambda l: pystrip(F.substring(l, 2, 1 << 30))
    words = F.flatten(F.transform("_kw", lambda l: F.filter(F.transform(F.split(after(l), ",", -1), lambda k: pystrip(k)), lambda k: k != "")))
    proc_line = F.get(F.filter("code_lines", lambda l: F.instr(F.lower(l), F_PROCEDURE) > 0), F.lit(0))
    df = once(
        df, F.array_join(F.concat(F.array("_purpose"), F.transform(F.slice("_head", 1, F.col("_ctx")), other)), " ").alias("purpose"),
        F.array_join(F.transform(F.slice("_head", F.col("_ctx") + 1, F.size("_head")),
                                 lambda l: F.when(is_ctx(l), pystrip(after(l))).otherwise(other(l))), " ").alias("context"),
        words.alias("keywords"),
        F.element_at(F.split(pystrip(F.replace(proc_line, F.lit("&"), F.lit(""))), WS + "+", -1), -1).alias("procedure"))
    kw_txt, code_txt = F.array_join("keywords", ", "), F.array_join("code_lines", "\n")
    entries = [(k, F.col(f"_fx_{k}")) for k in fixed] + [
        ("procedure", F.coalesce("procedure", F.lit(""))), ("purpose", F.col("purpose")), ("keywords", kw_txt), ("context", F.col("context"))]
    shown = F.array_join(F.slice("code_lines", 1, embed_lines), "\n") if embed_lines else code_txt
    fk = F.concat_ws("/", *[F.col(k).cast("string") for k in file_keys])
    df = df.withColumn("chunk_no", (F.col("_i") + 1).cast("bigint"))
    return df.select(
        *file_keys, "chunk_no", chunk_id(fk, F.col("chunk_no")).alias("chunk_id"), "procedure", "purpose", "keywords", "context",
        code_txt.alias("code"), F.size("code_lines").cast("bigint").alias("n_code_lines"),
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries])).alias("metadata"),
        F.concat(F.lit("PURPOSE:\n"), F.col("purpose"), F.lit("\n\nKEYWORDS:\n"), kw_txt, F.lit("\n\nCONTEXT:\n"), F.col("context"),
                 F.lit("\n\nCODE:\n"), shown).alias("embedding_text"))


def after_colon_raw() -> Column:
    return F.expr("substring(_s, instr(_s, ':') + 1)")


# ------------------------------------------------------------------ offsets
def line_offsets(lines: DataFrame, file_keys: list[str]) -> DataFrame:
    """W5 over a line table whose breaks are one character long: offset of each
    line start.  ``file_line_offsets`` counts the breaks of the file itself."""
    w = (Window.partitionBy(*file_keys).orderBy("line_no")
         .rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("bigint"))


def linecol_to_offset(line_offset: Column, col: Column) -> Column:
    """1-based column on a line → 0-based character offset in the file."""
    return (line_offset + col - 1).cast("bigint")
