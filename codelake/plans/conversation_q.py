"""Registered queries for conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import templates as T
from codelake.operators import conversation as CV
from codelake.plans import fixtures as D
from codelake.plans.registry import query
from codelake.sources.tables import read_table

SEEN_BEFORE = "2024-01-15 00:00:00"   # comments answered by an earlier poll
# Timestamps leave the registered queries as one fixed text format (both engines print it alike).
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS_FMT = "%Y-%m-%d %H:%M:%S.%f"


def ts_text(c):
    return F.date_format(F.col(c), TS_FMT).alias(c)


def sql_ts(c):
    return f"strftime({c}, '{SQL_TS_FMT}') {c.split('.')[-1]}"


def comments(spark, sf_dir):
    return CV.union_comments(D.d9_comment_pages(spark, sf_dir))


SQL_COMMENTS = f"""comments as (
  select 'issue-' || cast(id as varchar) uid, pr, id, cast(replace(created, 'Z', '') as timestamp) created_at,
    coalesce(body, '') body, author, 'issue' source, 0 feed_order from {D.SQL_D9} where feed = 'issue'
  union all
  select 'review-comment-' || cast(id as varchar), pr, id, cast(replace(created, 'Z', '') as timestamp),
    coalesce(body, ''), author, 'review', 1 from {D.SQL_D9} where feed = 'review'
  union all
  select 'review-submission-' || cast(id as varchar), pr, id, cast(replace(created, 'Z', '') as timestamp),
    body, author, 'submission', 2 from {D.SQL_D9} where feed = 'submission' and body is not null and body <> '')"""

SQL_LATEST = f"""select pr, uid, {sql_ts('created_at')}, body, author, source from (
  select *, row_number() over (partition by pr order by created_at desc, feed_order, id) rk from comments) where rk = 1"""


@query("comment_union", f"""with {SQL_COMMENTS}
select uid, pr, {sql_ts('created_at')}, body, author, source from comments""")
def comment_union(spark, sf_dir):
    """U1 + P3 + F23: three landed feeds as one comment table."""
    return comments(spark, sf_dir).select("uid", "pr", ts_text("created_at"), "body", "author", "source")


@query("latest_comment", f"""with {SQL_COMMENTS}
{SQL_LATEST}""")
def latest_comment(spark, sf_dir):
    """A3: newest comment per pull request, union order breaks ties."""
    return CV.latest_comment(comments(spark, sf_dir), "pr").withColumn("created_at", ts_text("created_at"))


@query("exclude_seen", f"""with {SQL_COMMENTS}
select uid, pr, {sql_ts('created_at')} from comments
where uid not in (select uid from comments where created_at < timestamp '{SEEN_BEFORE}')""")
def exclude_seen(spark, sf_dir):
    """Comments not answered by an earlier poll (anti-join on uid)."""
    c = comments(spark, sf_dir)
    seen = c.filter(F.col("created_at") < F.lit(SEEN_BEFORE).cast("timestamp_ntz")).select("uid")
    return CV.exclude_seen(c, seen).select("uid", "pr", ts_text("created_at"))


@query("latest_open", f"""select o_orderkey, {sql_ts('o_orderdate')} from orders where o_orderstatus = 'O'
order by o_orderdate desc, o_orderkey desc limit 1""")
def latest_open(spark, sf_dir):
    """P8 + T2: the newest open item (orders with status 'O' stand for open PRs)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return CV.newest_open(o, "o_orderstatus", "O", "o_orderdate", "o_orderkey").select("o_orderkey",
                                                                                       ts_text("o_orderdate"))


_EXTS = "['.c', '.cc', '.cpp', '.h', '.hpp', '.py', '.md', '/Makefile', '.cu']"


def _review_names(spark, sf_dir):
    pages = D.d7_paths(spark, sf_dir).select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                             CV.short_name(F.col("path")).alias("name"))
    exts = F.array(*[F.lit(x) for x in (".c", ".cc", ".cpp", ".h", ".hpp", ".py", ".md", "/Makefile", ".cu")])
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
        F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"),
                 F.element_at(exts, (F.col("doc_id") % 9 + 1).cast("int"))).alias("name"))
    return pages.unionByName(docs)


@query("review_files", f"""with n as (
  select 'page' src, page_id id, string_split(path, '/')[-1] name from {D.SQL_D7}
  union all select 'doc', doc_id, concat('src/doc', cast(doc_id as varchar), {_EXTS}[doc_id % 9 + 1]) from documents)
select src, id, name from n where suffix(name, '.c') or suffix(name, '.cc') or suffix(name, '.cpp')
  or suffix(name, '.h') or suffix(name, '.hpp') or instr(name, 'Makefile') > 0""")
def review_files(spark, sf_dir):
    """P1 on page names and document file names."""
    n = _review_names(spark, sf_dir)
    return n.filter(CV.is_review_file(F.col("name")))


@query("short_name", """select page_id, string_split(url, '/')[-1] short_name from pages""")
def short_name(spark, sf_dir):
    """text after the last '/'."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", CV.short_name(F.col("url")).alias("short_name"))


@query("review_prompt", """with f as (select concat(source, '#', cast(doc_id // 200 as varchar)) pr, concat(lang, '/doc', cast(doc_id as varchar), '.cpp') name, doc_id from documents),
disk as (select concat(d.lang, '/doc', cast(d.doc_id as varchar), '.cpp') name, d.text from documents d
  where d.doc_id in (select doc_id from labels)),
s as (select f.pr, f.name, concat(chr(10), '===== FILE: ', f.name, ' =====', chr(10), disk.text, chr(10)) section
  from f join disk using (name)),
b as (select pr, string_agg(section, '' order by name) blob, count(*) n_files from s group by pr)
select pr, n_files, """ + T.sql_render("review", errors="''", sources="blob") + """ prompt from b""")
def review_prompt(spark, sf_dir):
    """J7 + A7 + F20: per pull request (a source's files out of 200 consecutive
    documents, so a request does not grow with the corpus), the review prompt
    over its files that exist on disk (documents with a labels row)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    name = F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".cpp"))
    pr_files = docs.select(F.concat(F.col("source"), F.lit("#"), F.expr("doc_id div 200").cast("string")).alias("pr"), name.alias("name"))
    on_disk = docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi") \
        .select(name.alias("name"), "text")
    blob = CV.source_blob(CV.source_sections(pr_files, on_disk), "pr")
    return blob.select("pr", "n_files", T.render_prompt("review", errors=F.lit(""), sources=F.col("blob"))
                       .alias("prompt"))
