"""Registered queries of the core operators and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import html as H
from tessera.functions import json as J
from tessera.functions import latex as L
from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.operators import report as R
from tessera.operators import scoring as S
from tessera.plans.shared import spread, written
from tessera.streaming.collect import distinct_stream, run_to_table

Query = Callable[[SparkSession, str], DataFrame]
#: The class of all white space as DuckDB spells it.
W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LN2 = repr(1 / math.log(2))
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

NEWS = [
    f"https://www.nbeacon.example/news/{part}" for part in ("articles/", "world-", "business-", "science-", "health-")
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql is not None:
            _sql[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    """Return the queries by name."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Return the SQL by query name."""
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read a table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null"))


def _clean(name: str, expression: Callable, sql: str) -> None:
    """Register a cleaning expression over the documents that it changes, next to its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _text(spark, sf_dir)
        return df.select("doc_id", expression(F.col("text")).alias("clean"), (expression(F.col("text")) != F.col("text")).alias("changed"))

    run.__name__ = name
    query(f"SELECT doc_id, clean, clean <> text AS changed FROM (SELECT doc_id, text, {sql} AS clean FROM documents WHERE text IS NOT NULL)")(run)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_clean("newline_collapse", T.collapse_newlines, r"regexp_replace(text, '\n+', chr(10), 'g')")
_clean("bracket_drop", T.drop_brackets, r"regexp_replace(text, '\[[^\n]*?\]', '', 'g')")
_clean("whitespace_collapse", T.collapse_whitespace, f"trim(regexp_replace(text, '{W}+', ' ', 'g'), ' ')")
_clean("tag_drop", T.drop_tags, "regexp_replace(text, '<[^>]*>', '', 'g')")
_clean(
    "punctuation_close",
    lambda c: T.close_punctuation(F.replace(c, F.lit(","), F.lit(" \u00a0,"))),
    rf"regexp_replace(regexp_replace(replace(text, ',', ' ' || chr(160) || ','), '{W}+([,.!?;:])', '\1', 'g'), '^{W}+|{W}+$', '', 'g')",
)
_clean("newline_strip", T.strip_newlines, "replace(text, chr(10), '')")
_clean("space_collapse", T.collapse_spaces, "regexp_replace(text, ' +', ' ', 'g')")
_clean(
    "paragraph_join",
    lambda c: T.join_paragraphs(F.split(F.replace(c, F.lit(". "), F.lit(".\u00a0")), "\n")),
    rf"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(text, '. ', '.' || chr(160)), chr(10)), lambda p: replace(p, chr(160), chr(10))), ''), '\n+', chr(10), 'g'), '^{W}+|{W}+$', '', 'g')",
)
_clean("valid_utf8", T.drop_invalid, "text")


@query(
    "SELECT source, count(text) AS samples, count(DISTINCT text) AS unique_texts, CAST(sum(length(text)) AS BIGINT) AS total_chars,"
    " round(avg(length(text)), 6) AS avg_chars, round(avg(strlen(text)), 6) AS avg_bytes FROM documents GROUP BY source"
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each corpus."""
    return C.corpus_stats(read(spark, sf_dir, "documents"), "text", "source")


@query(
    "SELECT doc_id, substring(text, 1, 5000) AS text FROM documents WHERE text IS NOT NULL AND length(text) > 2000"
)
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts, cut; the stored length prunes the scan."""
    df = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return C.filter_then_truncate(df, "text", 2000, 5000, "n_chars").select("doc_id", "text")


@query("SELECT doc_id, substring(text, 1, 1500) AS text FROM documents WHERE length(substring(text, 1, 1500)) > 1499")
def truncate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut and then filtered."""
    return C.truncate_then_filter(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1499, 1500)


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def filled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are neither null nor empty."""
    return C.filled(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id")


@query(
    "SELECT * FROM (SELECT doc_id, substring(regexp_replace(replace(text, chr(10), ''), ' +', ' ', 'g'), 201, 500) AS part FROM documents WHERE text IS NOT NULL)"
    " WHERE len(regexp_extract_all(part, '[a-zA-Z]')) > 0.6 * 500"
)
def letter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each text, if most of it is letters."""
    part = T.cut(T.collapse_spaces(T.strip_newlines(F.col("text"))), 200, 700)
    return C.mostly_letters(_text(spark, sf_dir).select("doc_id", part.alias("part")), "part", 200, 700)


def _markers_sql() -> str:
    listed = ", ".join(_quoted(m) for m in T.MARKERS)
    return (
        "SELECT page_id, list_reduce(list_prepend(content, [" + listed + "]), lambda a, m: CASE WHEN instr(a, m) > 0 THEN"
        " substring(a, 1, instr(a, m) - 1) ELSE a END) AS body FROM (SELECT page_id, replace(content, chr(10) || 'Categories', chr(10) || 'References') AS content"
        " FROM wikipedia_crawler WHERE content IS NOT NULL)"
    )


@query(_markers_sql())
def marker_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at the markers of their end sections."""
    pages = spread(read(spark, sf_dir, "wikipedia_crawler").select("page_id", "content").filter("content is not null"))
    content = F.replace("content", F.lit("\nCategories"), F.lit("\nReferences"))
    return pages.select("page_id", content.alias("content")).select(
        "page_id", T.cut_at_markers(F.col("content")).alias("body")
    )


_TEX = (
    r"'\title{' || substring(text, 1, 40) || '}\date{x}\author{a{b}c}\maketitle\begin{abstract}' || substring(text, 1, 200) ||"
    r" '\end{abstract}\begin{document}' || replace(replace(text, ',', ' ,'), '. ', ' <b>x</b>\href{u}{t}. ') || '\end{document}'"
)


@query(
    rf"""
    WITH src AS (SELECT doc_id, {_TEX} AS s FROM documents WHERE text IS NOT NULL),
    front AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\maketitle', '', 'g'), '(?s)\\date\{{.*?\}}', '', 'g'),
        '(?s)\\author\{{.*?\}}', '', 'g'), '\\href\{{[^\n]*?\}}\{{([^\n]*?)\}}', '\1', 'g') AS s FROM src),
    f AS (SELECT doc_id, regexp_extract(s, '(?s)\\title\{{(.*?)\}}', 1) AS t, regexp_extract(s, '(?s)\\begin\{{abstract\}}(.*?)\\end\{{abstract\}}', 1) AS a,
        regexp_extract(regexp_replace(s, '(?s)\\begin\{{abstract\}}.*?\\end\{{abstract\}}', ''), '(?s)\\begin\{{document\}}(.*?)\\end\{{document\}}', 1) AS b FROM front),
    c AS (SELECT doc_id, trim(regexp_replace(t, '{W}+', ' ', 'g'), ' ') AS tt, t, a, trim(regexp_replace(a, '{W}+', ' ', 'g'), ' ') AS aa,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(b, '{W}+', ' ', 'g'), ' '), '<[^>]*>', '', 'g'),
        '{W}+([,.!?;:])', '\1', 'g'), '^{W}+|{W}+$', '', 'g'), '{W}+', ' ', 'g'), ' ') AS bb FROM f)
    SELECT doc_id, CASE WHEN t <> '' THEN tt || chr(10) ELSE '' END || CASE WHEN a <> '' THEN '§ Abstract ' || aa ELSE '' END || bb AS paper FROM c
    """
)
def latex_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, abstract and body of sources built around the documents."""
    source = F.expr(_TEX.replace("\\", "\\\\"))
    return L.with_paper(_text(spark, sf_dir).select("doc_id", source.alias("s")), "s", "paper").select("doc_id", "paper")


_TEX_FILES = r"""SELECT html_url AS archive, file_id AS ord, content,
    CASE file_id % 5 WHEN 0 THEN 'a/paper.tex' WHEN 1 THEN 'main.tex' WHEN 2 THEN 'x/one.tex' WHEN 3 THEN 'notes.txt' ELSE 'two.tex' END AS path,
    CASE file_id % 3 WHEN 0 THEN '\documentclass' WHEN 1 THEN '\begin{document}' ELSE '' END AS head FROM github_crawler WHERE html_url IS NOT NULL"""


@query(
    f"""
    WITH f AS ({_TEX_FILES}), t AS (SELECT *, string_split(path, '/')[-1] AS name FROM f WHERE path LIKE '%.tex'),
    r AS (SELECT *, CASE WHEN name = 'main.tex' THEN 0 WHEN name = 'paper.tex' THEN 1 WHEN contains(head, '\\documentclass') THEN 4
        WHEN contains(head, '\\begin{{document}}') THEN 5 ELSE 6 END AS rank, count(*) OVER (PARTITION BY archive) AS files,
        row_number() OVER (PARTITION BY archive ORDER BY CASE WHEN name = 'main.tex' THEN 0 WHEN name = 'paper.tex' THEN 1 WHEN contains(head, '\\documentclass') THEN 4
        WHEN contains(head, '\\begin{{document}}') THEN 5 ELSE 6 END, ord) AS n FROM t)
    SELECT archive, path FROM r WHERE n = 1 AND (rank < 6 OR files = 1)
    """.replace(chr(92) * 2, chr(92))
)
def main_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main file of each repository, taken as an archive of sources."""
    read(spark, sf_dir, "github_crawler").createOrReplaceTempView("github_crawler")
    return C.main_files(spark.sql(_TEX_FILES.replace(chr(92), chr(92) * 2)), "archive", "ord", "path", "head")


@query(
    "SELECT html_url, min_by(target_file, (md5('7/' || html_url || '/' || target_file), target_file)) AS target_file FROM github_crawler"
    " WHERE html_url IS NOT NULL AND target_file IS NOT NULL GROUP BY html_url"
)
def random_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each repository, picked by hash."""
    files = read(spark, sf_dir, "github_crawler").filter("html_url is not null")
    return C.random_file(files, "html_url", "target_file", "7")


@query(
    "SELECT file_id, string_split(html_url, '/')[-2] AS owner, string_split(html_url, '/')[-1] AS repo, string_split(target_file, '/')[-1] AS name,"
    " suffix(target_file, '.py') AS is_python FROM github_crawler WHERE html_url IS NOT NULL AND target_file IS NOT NULL"
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of repository addresses and paths."""
    owner, repo = T.owner_and_repo(F.col("html_url"))
    return read(spark, sf_dir, "github_crawler").filter("html_url is not null and target_file is not null").select(
        "file_id", owner.alias("owner"), repo.alias("repo"), T.basename(F.col("target_file")).alias("name"),
        F.endswith("target_file", F.lit(".py")).alias("is_python"),
    )


@query("SELECT article_id FROM bbc_crawler WHERE " + " OR ".join(f"starts_with(url, {_quoted(p)})" for p in NEWS))
def news_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose address begins like one of an article."""
    return read(spark, sf_dir, "bbc_crawler").filter(T.starts_with_any(F.col("url"), NEWS)).select("article_id")


@query(
    "SELECT article_id, string_split(string_split('https://w.example/works/' || article_id || '/chapters/' || length(url), '/chapters')[1], '/')[-1] AS work_id,"
    " replace(replace('d=<DATE>&p=<PAGE>', '<DATE>', search_date), '<PAGE>', CAST(batch_no * 10 AS VARCHAR)) AS request FROM bbc_crawler WHERE url IS NOT NULL AND search_date IS NOT NULL"
)
def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids out of links, and request addresses out of a template."""
    link = F.concat(F.lit("https://w.example/works/"), F.col("article_id"), F.lit("/chapters/"), F.length("url"))
    request = T.fill_template("d=<DATE>&p=<PAGE>", {"DATE": F.col("search_date"), "PAGE": (F.col("batch_no") * 10).cast("string")})
    return read(spark, sf_dir, "bbc_crawler").filter("url is not null and search_date is not null").select(
        "article_id", T.work_id(link).alias("work_id"), request.alias("request")
    )


def _escaped(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("SELECT page_id, content AS text FROM wikipedia_crawler WHERE content IS NOT NULL")
def html_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages built around the articles, without tables, formulas and references; a redirect beside each has none."""
    html = F.concat(
        F.lit("<div>"), F.when(F.col("redirect"), F.lit('<div class="redirectMsg">to</div>')).otherwise(""), F.lit("<p>"), _escaped(F.col("content")), F.lit("</p><table><tr><td>x</td></tr></table><math>y</math>"),
        F.lit('<h2><span id="References">References</span></h2><ol><li>z</li></ol></div>'),
    )
    pages = spread(read(spark, sf_dir, "wikipedia_crawler").select("page_id", "content").filter("content is not null"))
    pages = pages.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("redirect"))
    return pages.select("page_id", H.over(H.page_text, html).alias("text")).filter("text is not null")


@query("SELECT article_id, url AS link FROM bbc_crawler WHERE url IS NOT NULL")
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages."""
    html = F.concat(F.lit('<p><a name="top">t</a><a class="x" href="'), _escaped(F.col("url")), F.lit('">go</a></p>'))
    pages = read(spark, sf_dir, "bbc_crawler").filter("url is not null")
    return pages.select("article_id", F.explode(H.over(H.links, html)).alias("link"))


@query("SELECT article_id, url AS link FROM bbc_crawler WHERE url IS NOT NULL")
def link_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of simple pages, by a pattern."""
    html = F.concat(F.lit('<p><a name="top">t</a><a class="x" href="'), F.col("url"), F.lit('">go</a></p>'))
    pages = read(spark, sf_dir, "bbc_crawler").filter("url is not null")
    return pages.select("article_id", F.explode(H.links_by_pattern(html)).alias("link"))


@query("SELECT article_id, extracted_contents AS text FROM bbc_crawler WHERE extracted_contents IS NOT NULL")
def embedded_news_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks out of the JSON that a news page carries in a script."""
    block = lambda p: F.struct(F.struct(p.alias("text")).alias("model"))
    blocks = F.struct(F.lit("text").alias("type"), F.struct(F.transform(F.split("extracted_contents", "\n"), block).alias("blocks")).alias("model"))
    image = F.from_json(F.lit('{"type":"image","model":{"blocks":[]}}'), "struct<type:string,model:struct<blocks:array<struct<model:struct<text:string>>>>>")
    page = F.create_map(F.concat(F.lit("/news/"), F.col("article_id")), F.struct(F.array(image, blocks).alias("contents")))
    data = F.to_json(F.struct(F.struct(F.struct(page.alias("page")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    pages = read(spark, sf_dir, "bbc_crawler").filter("extracted_contents is not null")
    found = pages.select("article_id", H.over(H.embedded_json, html).alias("data"))
    return found.select("article_id", J.news_text(F.col("data")).alias("text"))


@query("SELECT page_id, title FROM wikipedia_crawler WHERE title IS NOT NULL")
def listing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles out of listing pages; pages without a list give none."""
    rows = F.to_json(F.struct(F.array(F.struct("title", F.col("rc_timestamp").alias("timestamp"))).alias("recentchanges")))
    page = F.when(F.col("title").isNotNull(), rows).otherwise("{}")
    pages = read(spark, sf_dir, "wikipedia_crawler").select("page_id", "title", "rc_timestamp")
    return pages.select("page_id", F.explode(J.field_of_each(page, "$.recentchanges", "title")).alias("title"))


@query(
    "SELECT file_id, content FROM github_crawler WHERE content IS NOT NULL UNION ALL SELECT file_id, NULL FROM github_crawler WHERE content IS NOT NULL"
)
def base64_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents through base64; an answer beside each that is no text becomes null."""
    sent = F.explode(F.array(F.base64(F.col("content").cast("binary")), F.lit("/////w==")))
    files = read(spark, sf_dir, "github_crawler").filter("content is not null")
    return files.select("file_id", sent.alias("sent")).select("file_id", J.base64_text(F.col("sent")).alias("content"))


_RANGE = "regexp_matches(created_range, '^\\d{4}-\\d{2}-\\d{2}\\.\\.\\d{4}-\\d{2}-\\d{2}$')"


@query(
    "SELECT hit_id, strftime(day, '%Y-%m-%d') AS iso, strftime(day, '%-m/%-d/%Y') AS us, strftime(day, '%Y%m%d') AS compact,"
    " strftime(day, '%Y-%m-%d') || 'T00:00:00Z' AS first_second, strftime(day, '%Y-%m-%d') || 'T23:59:59Z' AS last_second FROM ("
    " SELECT hit_id, unnest(generate_series(CAST(substring(created_range, 1, 10) AS TIMESTAMP), CAST(substring(created_range, 13, 10) AS TIMESTAMP), INTERVAL 1 DAY)) AS day"
    f" FROM repo_search WHERE {_RANGE} AND substring(created_range, 1, 10) <= substring(created_range, 13, 10))"
)
def range_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the ranges searched, in all spellings."""
    hits = read(spark, sf_dir, "repo_search").filter(F.rlike("created_range", F.lit(r"^\d{4}-\d{2}-\d{2}\.\.\d{4}-\d{2}-\d{2}$")))
    start, end = (D.valid_date(F.substring("created_range", at, 10)) for at in (1, 13))
    day = F.col("day")
    first, last = D.day_bounds(day)
    return hits.select("hit_id", F.explode(D.days(start, end)).alias("day")).select(
        "hit_id", F.date_format(day, "yyyy-MM-dd").alias("iso"), D.us_date(day).alias("us"), D.compact(day).alias("compact"),
        first.alias("first_second"), last.alias("last_second"),
    )


@query(
    "SELECT article_id, strftime(strptime(search_date, '%m/%d/%Y'), '%Y-%m-%d') AS iso, date_diff('day', CAST(strptime(search_date, '%m/%d/%Y') AS DATE), DATE '2030-01-01') || '-' ||"
    " (date_diff('day', CAST(strptime(search_date, '%m/%d/%Y') AS DATE), DATE '2030-01-01') + 14) || '+days' AS age FROM bbc_crawler WHERE search_date IS NOT NULL"
)
def age_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search dates read back, and as ages."""
    day = D.from_us_date(F.col("search_date"))
    age = D.age_window(F.date_sub(day, 14), day, F.lit("2030-01-01").cast("date"))
    return read(spark, sf_dir, "bbc_crawler").filter("search_date is not null").select(
        "article_id", F.date_format(day, "yyyy-MM-dd").alias("iso"), age.alias("age")
    )


@query("SELECT min(doc_id) AS doc_id, substring(text, 1, 1000) AS text FROM documents WHERE text IS NOT NULL GROUP BY 2")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text, after truncation."""
    cut = _text(spark, sf_dir).withColumn("text", T.truncate(F.col("text"), 1000))
    return C.distinct_texts(cut, "text", "doc_id").select("doc_id", "text")


@query("SELECT sha256(content) AS content_hash, min(file_id) AS file_id, count(*) AS copies FROM github_crawler WHERE content IS NOT NULL GROUP BY 1")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the hash of their whole content."""
    return C.content_hashes(read(spark, sf_dir, "github_crawler"), "content", "file_id")


@query("SELECT html_url, default_branch, min(hit_id) AS hit_id FROM repo_search GROUP BY html_url, default_branch")
def first_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository found, once, in order of discovery."""
    return C.first_seen(read(spark, sf_dir, "repo_search"), ["html_url", "default_branch"], "hit_id")


@query("SELECT url, min(article_id) AS article_id FROM bbc_crawler WHERE url IS NOT NULL GROUP BY url")
def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address once."""
    return C.first_seen(read(spark, sf_dir, "bbc_crawler").filter("url is not null"), ["url"], "article_id")


@query(
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) AS first_index FROM documents WHERE text IS NOT NULL"
)
def first_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first of equal text in its corpus."""
    df = read(spark, sf_dir, "documents").select("doc_id", "source", "text").filter("text is not null")
    return C.first_index(df, "text", "doc_id", "source").select("doc_id", "first_index")


@query(
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 50"
)
def capped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first samples of each corpus."""
    return C.capped(read(spark, sf_dir, "documents").select("source", "doc_id"), 50, "doc_id", "source")


@query("SELECT doc_id, text, length(text) AS n FROM documents ORDER BY doc_id LIMIT 20")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first samples with their lengths."""
    return C.capped(read(spark, sf_dir, "documents").select("doc_id", "text"), 20, "doc_id").withColumn("n", F.length("text"))


@query(
    "SELECT * EXCLUDE (seen) FROM (SELECT search_language, hit_id, result_page, coalesce(sum(CAST(coalesce(stars, 0) < 3 AS INT)) OVER (PARTITION BY search_language ORDER BY hit_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM repo_search) WHERE seen < 5"
)
def empty_page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read until the fifth that is as good as empty."""
    pages = read(spark, sf_dir, "repo_search").select("search_language", "hit_id", "result_page", "stars")
    empty = F.coalesce("stars", F.lit(0)) < 3
    return C.until_empty_pages(pages, "search_language", "hit_id", empty).drop("stars")


_WORDS = f"list_filter(string_split(regexp_replace(text, '{W}+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(
    f"SELECT doc_id, n AS tokens, CAST(ceil(n / 64.0) AS BIGINT) AS chunks, CAST(n - ceil(n / 64.0) AS BIGINT) AS scored FROM (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)"
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and scored tokens of each document."""
    return S.chunk_counts(_text(spark, sf_dir), "doc_id", F.size(T.words(F.col("text"))), 64)


@query(
    f"SELECT doc_id, n AS tokens, CAST(ceil(n / 62.0) AS BIGINT) AS chunks, CAST(n - ceil(n / 62.0) AS BIGINT) AS scored FROM (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)"
)
def bos_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two start tokens in front of every chunk."""
    return S.chunk_counts(_text(spark, sf_dir), "doc_id", F.size(T.words(F.col("text"))), 64, bos=2)


@query(
    "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))))) + CAST(list_max(embedding) AS DOUBLE)"
    " - CAST(embedding[label + 1] AS DOUBLE), 5) AS nll FROM embeddings"
)
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a target under each row of logits."""
    nll = S.log_softmax_nll(F.col("embedding"), F.col("label"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(nll, 5).alias("nll"))


@query(
    "WITH r AS (SELECT vec_id // 50 AS sample, vec_id % 50 AS pos, label, embedding AS e FROM embeddings),"
    " p AS (SELECT sample, label, lag(e) OVER (PARTITION BY sample, pos // 15 ORDER BY pos) AS e FROM r)"
    " SELECT sample, round(coalesce(sum(ln(list_sum(list_transform(e, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(e) AS DOUBLE))))) + CAST(list_max(e) AS DOUBLE) - CAST(e[label + 1] AS DOUBLE)), 0), 4) AS nll,"
    " count(*) AS tokens FROM p GROUP BY sample"
)
def chunked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of samples made of rows of logits, in chunks of 16 with one start token."""
    rows = read(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 50").alias("sample"), F.expr("vec_id % 50").alias("pos"), "embedding", "label"
    )
    found = S.shifted_nll(rows, "sample", "pos", "embedding", "label", 16, bos=1)
    return found.select("sample", F.round("nll", 4).alias("nll"), "tokens")


_TOKENS = f"SELECT source, unnest({_WORDS}) AS tok, unnest(range(len({_WORDS}))) AS pos FROM documents WHERE text IS NOT NULL"


@query(
    f"WITH t AS ({_TOKENS}), c AS (SELECT source, tok, count(*) AS n, sum(CAST(pos % 1024 <> 0 AS INT)) AS s FROM t GROUP BY 1, 2)"
    " SELECT source, round(sum(s * -ln(n / tot)), 3) AS nll, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(s) AS BIGINT) AS scored FROM"
    " (SELECT *, sum(n) OVER (PARTITION BY source) AS tot FROM c) GROUP BY source"
)
def unigram_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corpus under its own unigram model."""
    found = S.unigram_scores(spread(read(spark, sf_dir, "documents").select("source", "text")), "text", "source")
    return found.withColumn("nll", F.round("nll", 3))


def _bigram_sql(size: int, bos: int, filters: str = "text IS NOT NULL", text: str = "text") -> str:
    step = size - bos
    words = _WORDS.replace("(text,", f"({text},")
    start = "coalesce(prev, '')" if bos else "prev"
    keep = "" if bos else "WHERE prev IS NOT NULL"
    return f"""WITH d AS (SELECT source, {words} AS w FROM documents WHERE {filters}),
    t AS (SELECT source, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    p AS (SELECT source, CASE WHEN (i - 1) % {step} <> 0 THEN w[i - 1] END AS prev, w[i] AS tok FROM t),
    c AS (SELECT source, {start} AS prev, tok, count(*) AS n FROM p {keep} GROUP BY 1, 2, 3),
    m AS (SELECT source, n, sum(n) OVER (PARTITION BY prev, tok) AS pair, sum(n) OVER (PARTITION BY prev) AS first FROM c)
    """


@query(_bigram_sql(64, 0) + "SELECT source, round(sum(n * -ln(pair / first)), 3) AS nll, CAST(sum(n) AS BIGINT) AS scored FROM m GROUP BY source")
def bigram_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corpus under a bigram model of all."""
    docs = spread(read(spark, sf_dir, "documents").select("source", "text").filter("text is not null"))
    return S.bigram_scores(docs, "text", "source", 64).withColumn("nll", F.round("nll", 3))


@query(_bigram_sql(64, 1) + "SELECT source, round(sum(n * -ln(pair / first)), 3) AS nll, CAST(sum(n) AS BIGINT) AS scored FROM m GROUP BY source")
def bigram_bos_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a start token in front of every chunk."""
    docs = spread(read(spark, sf_dir, "documents").select("source", "text").filter("text is not null"))
    return S.bigram_scores(docs, "text", "source", 64, bos=1).withColumn("nll", F.round("nll", 3))


@query(
    f"""WITH s AS (SELECT source, text, min(doc_id) AS doc_id FROM (SELECT doc_id, source, substring(text, 1, 5000) AS text FROM documents WHERE length(text) > 500) GROUP BY 1, 2),
    d AS (SELECT source, text, {_WORDS} AS w FROM s), z AS (SELECT source, count(*) AS samples, sum(strlen(text)) AS bytes FROM d GROUP BY 1),
    t AS (SELECT source, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    p AS (SELECT source, w[i - 1] AS prev, w[i] AS tok FROM t WHERE (i - 1) % 1024 <> 0),
    c AS (SELECT source, prev, tok, count(*) AS n FROM p GROUP BY 1, 2, 3),
    m AS (SELECT source, n, sum(n) OVER (PARTITION BY prev, tok) AS pair, sum(n) OVER (PARTITION BY prev) AS first FROM c),
    q AS (SELECT source, sum(n * -ln(pair / first)) AS nll FROM m GROUP BY 1)
    SELECT source, samples, round(coalesce(nll, 0) / bytes * {LN2} * 0.125 * 100, 6) AS compression_rate FROM z LEFT JOIN q USING (source)"""
)
def bigram_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression rate of each corpus under a bigram model, after filter, cut and deduplication."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"))
    cut = C.filter_then_truncate(docs, "text", 500, 5000, "n_chars")
    kept = written(C.distinct_texts(cut, "text", "doc_id", "source").select("source", "text"), "bigram-kept")
    sizes = kept.groupBy("source").agg(F.count("*").alias("samples"), F.sum(F.octet_length("text")).alias("bytes"))
    scores = S.bigram_scores(kept, "text", "source")
    rate = S.compression_rate(F.coalesce("nll", F.lit(0.0)), F.col("bytes"))
    return sizes.join(scores, "source", "left").select("source", "samples", F.round(rate, 6).alias("compression_rate"))


_BYTES = "SELECT source, strlen(text) AS b, length(text) AS c FROM documents WHERE text IS NOT NULL"


@query(
    f"SELECT source, round(avg((b - ceil(b / 255.0)) * ln(256)), 4) AS neg_log_prob_sum, round(avg(b), 4) AS avg_tokens, round(avg(c), 4) AS avg_chars,"
    f" round(avg(b), 4) AS avg_bytes, count(*) AS sample_count, round(avg((b - ceil(b / 255.0)) * ln(256)) / avg(b) * {LN2} * 0.125 * 100, 6) AS compression_rate FROM ({_BYTES}) GROUP BY source"
)
def batched_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs of the uniform byte model, scored in padded batches with a start token."""
    docs = spread(read(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("idx"), "text"))
    config = S.EvaluationConfig("local/uniform", "documents", "uniform", add_bos=True, chunk_size=256, batch_size=16)
    log = S.run_log(S.score(docs, config), "dataset")
    return log.select(
        F.col("dataset").alias("source"), F.round("neg_log_prob_sum", 4).alias("neg_log_prob_sum"), F.round("`avg tokens`", 4).alias("avg_tokens"),
        F.round("`avg character count`", 4).alias("avg_chars"), F.round("`avg bytes`", 4).alias("avg_bytes"), "sample_count",
        F.round("compression_rate", 6).alias("compression_rate"),
    )


_FIGURES = {
    "bpc": f"nll / chars * {LN2}",
    "bpb": f"nll / bytes * {LN2}",
    "compression_rate": f"nll / bytes * {LN2} * 0.125 * 100",
    "nats_per_char": "nll / chars",
}
#: A figure, null if it is not a number. DuckDB folds isnan() away by Parquet statistics, which leave NaN out.
_NUM = 'CASE WHEN CAST("{0}" AS VARCHAR) <> \'nan\' THEN "{0}" END'


def _latest_sql(metric: str) -> str:
    return f"""WITH n AS (SELECT *, {_NUM.format("neg_log_prob_sum")} AS nll, nullif({_NUM.format("avg character count")}, 0) AS chars,
        nullif({_NUM.format("avg bytes")}, 0) AS bytes, {_NUM.format("parameters count")} AS params, string_split(data_path, '/')[-1] AS dataset FROM run_log WHERE model_name_or_path IS NOT NULL),
    v AS (SELECT model_name_or_path, dataset, run_ts, ingested_at, run_id, {_FIGURES[metric]} AS value FROM n WHERE dataset IS NOT NULL),
    l AS (SELECT model_name_or_path, dataset, arg_max(value, (run_ts, ingested_at, run_id)) AS value FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT model_name_or_path, arg_max(params, (run_ts, ingested_at, run_id)) AS parameters_b FROM n WHERE params IS NOT NULL GROUP BY 1),
    a AS (SELECT model_name_or_path, round(avg(value), 6) AS average, count(*) AS n_datasets FROM l GROUP BY 1)
    """


def _board(metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.leaderboard(read(spark, sf_dir, "run_log"), metric)

    run.__name__ = f"leaderboard_{metric}"
    query(
        _latest_sql(metric)
        + "SELECT model_name_or_path, string_split(model_name_or_path, '/')[-1] AS model, parameters_b, average, n_datasets,"
        " CAST(row_number() OVER (ORDER BY average, model_name_or_path) AS INT) AS position FROM a LEFT JOIN q USING (model_name_or_path)"
    )(run)


for _metric in R.METRICS:
    _board(_metric)


@query(_latest_sql("bpc") + "SELECT model_name_or_path, dataset, round(value, 6) AS value FROM l")
def latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure of each model and data set from its latest log."""
    return R.latest(read(spark, sf_dir, "run_log")).withColumn("value", F.round("value", 6))


#: The sites of the report, one column each.
_SITES = [
    "ao3_chinese", "ao3_english", "arxiv_computer_science", "arxiv_physics", "bbc_news", "github_cpp", "github_python", "wikipedia_arabic",
    "wikipedia_chinese", "wikipedia_english", "wikipedia_french", "wikipedia_german", "wikipedia_japanese", "wikipedia_spanish",
]


@query(
    _latest_sql("bpb")
    + ", w AS (SELECT model_name_or_path, regexp_extract(dataset, '^(.*)_[0-9]+to[0-9]+', 1) AS site, value FROM l) SELECT model_name_or_path, "
    + ", ".join(f"round(max(CASE WHEN site = '{s}' THEN value END), 6) AS {s}" for s in _SITES)
    + " FROM w GROUP BY 1"
)
def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each model and a column for each site, with the worst figure."""
    logs = R.latest(read(spark, sf_dir, "run_log"), "bpb")
    site = F.regexp_extract("dataset", "^(.*)_[0-9]+to[0-9]+", 1)
    wide = R.pivot(logs.withColumn("dataset", site), _SITES)
    return wide.select("model_name_or_path", *(F.round(s, 6).alias(s) for s in _SITES))


@query(_latest_sql("bpc") + "SELECT model_name_or_path, average FROM a ORDER BY average, model_name_or_path LIMIT 7")
def leaderboard_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best models."""
    return R.top(read(spark, sf_dir, "run_log"))


@query(
    _latest_sql("bpc")
    + f""", b AS (SELECT l.* FROM l JOIN (SELECT model_name_or_path FROM a ORDER BY average, model_name_or_path LIMIT 7) USING (model_name_or_path)),
    s AS (SELECT *, (value - min(value) OVER (PARTITION BY dataset)) / nullif(max(value) OVER (PARTITION BY dataset) - min(value) OVER (PARTITION BY dataset), 0) AS u FROM b),
    g AS (SELECT dataset, round({2 * math.pi!r} * (row_number() OVER (ORDER BY dataset) - 1) / count(*) OVER (), 6) AS angle FROM (SELECT DISTINCT dataset FROM b))
    SELECT model_name_or_path, dataset, round(value, 6) AS value, round((1 - u) * (0.95 - 0.80) + 0.80, 6) AS scaled, angle FROM s JOIN g USING (dataset)"""
)
def radar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled figures of the best models with their place on a circle."""
    return R.profile(read(spark, sf_dir, "run_log"))


@query(
    _latest_sql("compression_rate")
    + """SELECT model_name_or_path, dataset, round((value - min(value) OVER (PARTITION BY dataset)) /
    nullif(max(value) OVER (PARTITION BY dataset) - min(value) OVER (PARTITION BY dataset), 0), 6) AS position FROM l"""
)
def colour_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each figure between the least and greatest of its data set."""
    return R.colour_position(read(spark, sf_dir, "run_log"), "compression_rate")


@query(
    _latest_sql("bpc")
    + """, t AS (SELECT model_name_or_path, average, CASE WHEN parameters_b < 2 THEN '1.5B' WHEN parameters_b < 5 THEN '3B' WHEN parameters_b < 8 THEN '7B'
    WHEN parameters_b < 11 THEN '9B' WHEN parameters_b < 20 THEN '14B' WHEN parameters_b IS NOT NULL THEN 'larger' END AS tier FROM a LEFT JOIN q USING (model_name_or_path))
    SELECT tier, model_name_or_path, average, CAST(row_number() OVER (PARTITION BY tier ORDER BY average, model_name_or_path) AS INT) AS rank FROM t WHERE tier IS NOT NULL"""
)
def tier_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within size tiers."""
    return R.leaderboard_by_tier(read(spark, sf_dir, "run_log"))


@query(
    _latest_sql("bpc")
    + """, m AS (SELECT strftime(run_ts, '%Y-%m') AS month, model_name_or_path, round(avg(value), 6) AS average FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY average, model_name_or_path) AS INT) AS rank FROM m)
    SELECT month, model_name_or_path, average, rank, lag(rank) OVER (PARTITION BY model_name_or_path ORDER BY month) - rank AS gained FROM r"""
)
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by month and their changes."""
    return R.rank_changes(read(spark, sf_dir, "run_log"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS texts FROM (SELECT DISTINCT substring(text, 1, 5000) AS text FROM documents WHERE length(text) > 1000)")
def streamed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples collected by a stream over the documents."""
    kept = _document_stream(spark, sf_dir).filter("length(text) > 1000").select(F.substring("text", 1, 5000).alias("text"))
    table = run_to_table(distinct_stream(kept, "text"), "streamed")
    return table.agg(F.count("*").alias("rows"), F.countDistinct("text").alias("texts"))


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the documents, be they one file or a folder of files."""
    schema = read(spark, sf_dir, "documents").schema
    reader = spark.readStream.schema(schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    if folder:
        return reader.parquet(f"{sf_dir}/documents.parquet")
    return reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
