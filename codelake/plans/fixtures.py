"""Derived inputs D1..D8: the driver tables hold no code markers, so the
registered queries decorate them with one deterministic projection.  Each
fixture exists twice, as a Spark DataFrame and as DuckDB SQL text used by
the oracle, and both compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators.ordering import global_index
from codelake.sources.tables import read_table

NL = "\n"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES: one row per ``\\n``-separated piece of every document."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.select("doc_id", "lang", "source",
                    F.posexplode(F.split("text", NL, -1)).alias("i", "x")) \
        .withColumn("i", F.col("i").cast("bigint"))


_SLOTS = 8          # of the oracle's line numbers per text line: marker lines take the ones between


def _with_markers(spark, sf_dir, pieces) -> DataFrame:
    """``(doc_id, source, lang, lines)``: each text line ``x`` at ``i`` becomes the lines ``pieces(x, i)``, which hold it whole."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.flatten(F.transform(F.split("text", NL, -1), pieces)).alias("lines"))


def line_table(files: DataFrame, *keep: str) -> DataFrame:
    """The lines of files as rows ``(*keep, line_no, line)``."""
    return files.select(*keep, F.posexplode("lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def d1_cpp_files(spark, sf_dir) -> DataFrame:
    """Annotated C++ files; before and after every seventh line's comment come marker lines."""
    return _with_markers(spark, sf_dir, lambda x, i: F.when(i % 7 == 0, F.array(
        F.lit("// AI_METADATA"), F.lit("// user_intent:"), F.concat(F.lit("// "), x), F.concat(F.lit("// function: f"), i.cast("string"))))
        .otherwise(F.array(F.concat(F.lit("    "), x))))


def d1_cpp_lines(spark, sf_dir) -> DataFrame:
    return line_table(d1_cpp_files(spark, sf_dir), "doc_id", "source", "lang")


def d2_bodies(spark, sf_dir) -> DataFrame:
    """Comment and prompt bodies."""
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("text")
    k = (F.col("conv_id") * 7 + F.col("turn")) % 10
    body = (F.when(k == 0, F.concat(F.lit("hi @assistant "), t))
            .when(k == 1, F.concat(F.lit("/agent-coder" + NL), t))
            .when(k == 2, F.concat(F.lit("note" + NL + "/agent-build" + NL
                                         + "error: undefined reference to foo" + NL), t))
            .when(k == 3, F.concat(F.lit("class: Foo"), F.col("conv_id").cast("string"),
                                   F.lit(NL + "file: src/foo.cpp" + NL + "function: bar" + NL), t))
            .when(k == 4, F.concat(F.lit("How to "), t))
            .when(k == 5, F.concat(F.lit("Can you explain "), t))
            .when(k == 6, F.concat(F.lit("Implement a new function in the Solver class in Solver.cpp. "), t))
            .when(k == 7, F.concat(F.lit("starter code for "), t))
            .when(k == 8, F.concat(F.lit("MODIFY_EXISTING_METHOD: "), t))
            .otherwise(t))
    return c.select("conv_id", "turn", "role", body.alias("body"))


def d3_fortran_files(spark, sf_dir) -> DataFrame:
    """D3: annotated Fortran files; headers are inserted, every text line stays whole."""
    return _with_markers(spark, sf_dir, lambda x, i: F.when(i % 9 == 0, F.array(
        F.concat(F.lit("! PURPOSE: "), x), F.concat(F.lit("! KEYWORDS: a, "), F.col("lang"), F.lit(", ")),
        F.concat(F.lit("! CONTEXT: "), F.col("source")), F.lit("! more"), F.concat(F.lit("module procedure p"), i.cast("string"))))
        .when(i % 9 == 7, F.array(x, F.lit("! END CODE CHUNK"))).otherwise(F.array(x)))


def d3_fortran_lines(spark, sf_dir) -> DataFrame:
    return line_table(d3_fortran_files(spark, sf_dir), "doc_id", "source")


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Distinct rows with ``num``, their number from 0 in ``order``, and how many there are (1 at least)."""
    d = global_index(rows.distinct(), list(order), "num")
    return d, max(1, d.count())


def d4_eval_pairs(spark, sf_dir) -> DataFrame:
    """Every document as generated code, with the benchmark code whose number, in the order of
    (item_id, text), is ``doc_id`` modulo their count; gaps and repeated ids leave every document one partner."""
    b, n = numbered(read_table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text")
    b = b.select("num", F.col("text").alias("b_text"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("d_text"))
    iid = F.col("item_id").cast("string")
    bench = F.concat(F.lit("#include <x.H> void Foo::bar(int a) { int tmp"), iid, F.lit(" = a; "),
                     F.replace(F.col("b_text"), F.lit("."), F.lit(";")), F.lit(" }"))
    gen = F.concat(F.lit("void Foo::bar(int a) { int t"), iid, F.lit(" = a; "),
                   F.replace(F.col("d_text"), F.lit("."), F.lit(";")), F.lit(" }"))
    return d.withColumn("num", F.col("item_id") % n).join(b, "num", "left").select("item_id", bench.alias("bench"), gen.alias("gen"))


def d5_files(spark, sf_dir) -> DataFrame:
    """The lines of each document before and after: every fifth one edited, and every
    fourth dropped in odd documents."""
    edited = F.transform(F.col("old_lines"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("~ "), x)).otherwise(x))
    kept = F.filter(edited, lambda x, i: ~((F.col("doc_id") % 2 == 1) & (i % 4 == 3)))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", NL, -1).alias("old_lines")) \
        .select("doc_id", "old_lines", kept.alias("new_lines"))


def d6_ast_dumps(spark, sf_dir) -> DataFrame:
    """AST-query dumps and compile commands per part."""
    p = read_table(spark, sf_dir, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    dump = F.concat(F.lit('Binding for "f":' + NL + "<FieldDecl 0x"), k, F.lit("> int  "),
                    F.col("p_name"), F.lit(";" + NL + "<src/p.H:"), s.cast("string"),
                    F.lit(":5, line:"), (s + 2).cast("string"), F.lit(":9>"))
    command = F.concat(F.lit("g++ -I/inc/"), s.cast("string"), F.lit(" -DSIZE="), s.cast("string"),
                       F.lit(' -DNAME=\\"p\\" \'-DTWO=a b\' "-I/inc dir/\\"q\\"" -DX=\\ y'), F.lit(" -std=c++17 -O2 -fopenmp -c f"), k, F.lit(".cpp"))
    return p.select("p_partkey", dump.alias("dump"), command.alias("command"))


def d7_paths(spark, sf_dir) -> DataFrame:
    """URL paths without query or fragment."""
    return read_table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


def d8_pair_files(spark, sf_dir) -> DataFrame:
    """instruction/response text files; every text line stays whole."""
    return _with_markers(spark, sf_dir, lambda x, i: F.when(i % 6 == 0, F.array(
        F.concat(F.lit("instruction: "), x), F.lit(""), F.lit("response: inline"))).otherwise(F.array(x)))


def d8_pair_lines(spark, sf_dir) -> DataFrame:
    return line_table(d8_pair_files(spark, sf_dir), "doc_id")


# ---------------------------------------------------------------- DuckDB text
SQL_LINES = """(select doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) i,
        unnest(string_split(text, chr(10))) x from documents)"""

def _sql_markers(keep: str, pieces: str) -> str:
    return f"""(select {keep}, i*{_SLOTS}+k line_no, line from (select {keep}, i, unnest(range(len(ls))) k, unnest(ls) line
      from (select *, {pieces} ls from {SQL_LINES})))"""


SQL_D1 = _sql_markers("doc_id, source, lang", """case when i%7=0 then ['// AI_METADATA', '// user_intent:', concat('// ', x),
  concat('// function: f', cast(i as varchar))] else [concat('    ', x)] end""")

SQL_D2 = """(select conv_id, turn, role, case (conv_id*7+turn)%10
  when 0 then concat('hi @assistant ', text)
  when 1 then concat('/agent-coder', chr(10), text)
  when 2 then concat('note', chr(10), '/agent-build', chr(10), 'error: undefined reference to foo', chr(10), text)
  when 3 then concat('class: Foo', cast(conv_id as varchar), chr(10), 'file: src/foo.cpp', chr(10), 'function: bar', chr(10), text)
  when 4 then concat('How to ', text)
  when 5 then concat('Can you explain ', text)
  when 6 then concat('Implement a new function in the Solver class in Solver.cpp. ', text)
  when 7 then concat('starter code for ', text)
  when 8 then concat('MODIFY_EXISTING_METHOD: ', text)
  else text end body from conversations)"""

SQL_D3 = _sql_markers("doc_id, source", """case when i%9=0 then [concat('! PURPOSE: ', x), concat('! KEYWORDS: a, ', lang, ', '),
  concat('! CONTEXT: ', source), '! more', concat('module procedure p', cast(i as varchar))]
  when i%9=7 then [x, '! END CODE CHUNK'] else [x] end""")

SQL_D4 = """(select d.doc_id item_id,
  concat('#include <x.H> void Foo::bar(int a) { int tmp', cast(d.doc_id as varchar), ' = a; ', replace(b.text,'.',';'), ' }') bench,
  concat('void Foo::bar(int a) { int t', cast(d.doc_id as varchar), ' = a; ', replace(d.text,'.',';'), ' }') gen
from documents d left join (select text, row_number() over (order by item_id nulls first, text nulls first)-1 num from (select distinct item_id, text from benchmark)) b
  on b.num=d.doc_id%(select greatest(count(*),1) from (select distinct item_id, text from benchmark)))"""

SQL_D5 = f"""(select doc_id, i line_no, x old_line, case when i%5=0 then concat('~ ', x) else x end new_line,
  doc_id%2=1 and i%4=3 dropped from {SQL_LINES})"""

SQL_D6 = """(select p_partkey,
  concat('Binding for "f":', chr(10), '<FieldDecl 0x', cast(p_partkey as varchar), '> int  ', p_name, ';', chr(10),
         '<src/p.H:', cast(p_size as varchar), ':5, line:', cast(p_size+2 as varchar), ':9>') dump,
  concat('g++ -I/inc/', cast(p_size as varchar), ' -DSIZE=', cast(p_size as varchar),
         ' -DNAME=\\"p\\" ''-DTWO=a b'' "-I/inc dir/\\"q\\"" -DX=\\ y',
         ' -std=c++17 -O2 -fopenmp -c f', cast(p_partkey as varchar), '.cpp') command from part)"""

SQL_D7 = """(select page_id, regexp_replace(url, '[?#].*$', '') path from pages)"""

SQL_D8 = _sql_markers("doc_id", "case when i%6=0 then [concat('instruction: ', x), '', 'response: inline'] else [x] end")


def d9_comment_pages(spark, sf_dir):
    """D9 (ours): landed comment pages derived from ``events``.

    feed by event type (click/signup → issue, view/error → review,
    purchase → submission), ISO-8601 ``Z`` timestamps, bodies with mentions,
    commands and empty texts, ``user_id`` as the pull request.
    """
    return d9_from_events(read_table(spark, sf_dir, "events"))


def d9_from_events(e: DataFrame) -> DataFrame:
    """D9 as a projection of an events DataFrame (batch or streaming)."""
    feed = (F.when(F.col("event_type").isin("click", "signup"), "issue")
            .when(F.col("event_type").isin("view", "error"), "review").otherwise("submission"))
    k = F.col("event_id") % 5
    props = F.col("props")
    body = (F.when(k == 0, F.concat(F.lit("hi @assistant "), props))
            .when(k == 2, F.concat(F.lit("/agent-build" + NL + "error: undefined reference to foo "), props))
            .when(k == 3, F.concat(F.lit("/agent-coder" + NL + "please fix "), props))
            .otherwise(props))
    # every fifth event also has a comment without text
    texts = F.when(k == 1, F.array(body, F.lit(""))).otherwise(F.array(body))
    return e.select(feed.alias("feed"), "event_id", F.col("user_id").alias("pr"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created"),
                    F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("author"),
                    F.posexplode(texts).alias("nth", "body")) \
        .select("feed", (F.col("event_id") * 2 + F.col("nth")).cast("bigint").alias("id"), "pr", "created", "body", "author")


SQL_D9 = """(select feed, event_id * 2 + nth id, pr, created, body, author from (
  select *, unnest(range(len(texts))) nth, unnest(texts) body from (
  select event_id, case when event_type in ('click', 'signup') then 'issue'
    when event_type in ('view', 'error') then 'review' else 'submission' end feed, user_id pr,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') created,
  case event_id % 5 when 0 then [concat('hi @assistant ', props)] when 1 then [props, '']
    when 2 then [concat('/agent-build', chr(10), 'error: undefined reference to foo ', props)]
    when 3 then [concat('/agent-coder', chr(10), 'please fix ', props)] else [props] end texts,
  concat('user', cast(user_id % 7 as varchar)) author from events)))"""
