"""Registered queries of sources, sinks, parsers and run reports, and their SQL."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import _document_stream, _escaped, _quoted, query, read
from tessera.functions import html as H
from tessera.functions import text as T
from tessera.operators import report as R
from tessera.operators import scoring as S
from tessera.plans.shared import new_path, spread
from tessera.schema import RUN_LOG_FIELDS
from tessera.sources import files, sinks, sites, web
from tessera.streaming.collect import distinct_stream, run_to_table


@query(
    "SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS INT) AS idx, text FROM documents WHERE dataset IS NOT NULL"
)
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written as JSON lists, a file for each data set, and read back with their positions."""
    path = new_path(spark, "exported")
    docs = read(spark, sf_dir, "documents").filter("dataset is not null")
    sinks.export_corpora(docs.select("dataset", F.col("doc_id").alias("idx"), "text"), path, ascii_only=False)
    return files.read_corpora(spark, path, "*.txt")


@query(
    "SELECT dataset, split_part(dataset, '_', 1) AS site, regexp_extract(dataset, '^[^_]+_(.*)_[0-9]{8}to[0-9]{8}$', 1) AS variant,"
    " CAST(strptime(regexp_extract(dataset, '_([0-9]{8})to', 1), '%Y%m%d') AS DATE) AS start_date,"
    " CAST(strptime(regexp_extract(dataset, 'to([0-9]{8})$', 1), '%Y%m%d') AS DATE) AS end_date, count(text) AS strings"
    " FROM documents WHERE dataset IS NOT NULL GROUP BY dataset"
)
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported lists by data set: the parts of the name, and how many elements are strings."""
    path = new_path(spark, "exported")
    docs = read(spark, sf_dir, "documents").filter("dataset is not null")
    sinks.export_corpora(docs.select("dataset", F.col("doc_id").alias("idx"), "text"), path)
    found = files.read_corpora(spark, path, "*.txt").groupBy("dataset").agg(F.count("text").alias("strings"))
    return files.dataset_fields(found).select("dataset", "site", "variant", "start_date", "end_date", "strings")


@query("SELECT dataset, doc_id AS idx, text FROM documents WHERE source LIKE 'wikipedia%'")
def corpus_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples stored by data set; those of one site are read back, and only their folders."""
    path = new_path(spark, "store")
    docs = read(spark, sf_dir, "documents").select("dataset", F.col("doc_id").alias("idx"), "text")
    sinks.write_corpus(docs, path)
    stored = spark.read.schema(docs.schema).parquet(path)
    return stored.filter(F.col("dataset").like("wikipedia%")).select("dataset", "idx", "text")


_NUMBERS = ["neg_log_prob_sum", "avg tokens", "avg character count", "parameters count", "avg bytes", "compression_rate"]
_PLAIN_KEYS = ["sample_count", "model_name_or_path", "tokenizer_name", "data_path", "chunk_size", "add_bos", "batch_size"]


@query(
    "SELECT "
    + ", ".join(f"round(CASE WHEN CAST(\"{c}\" AS VARCHAR) <> 'nan' THEN \"{c}\" END, 6) AS {c.replace(' ', '_')}" for c in _NUMBERS)
    + f", {', '.join(_PLAIN_KEYS)}, array_to_string(requirements, ' ') AS requirements, CAST(cardinality(model_args) AS INT) AS model_args FROM run_log"
)
def run_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All run logs appended as JSON and read back, with the keys that a log lacks as nulls."""
    path = new_path(spark, "logs")
    logs = read(spark, sf_dir, "run_log").select(*(F.col(f"`{c}`") for c in RUN_LOG_FIELDS))
    sinks.write_run_logs(logs, path)
    found = files.read_run_logs(spark, path)
    figures = [F.round(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")), 6).alias(c.replace(" ", "_")) for c in _NUMBERS]
    size = F.when(F.col("model_args").isNotNull(), F.size("model_args")).alias("model_args")
    return found.select(*figures, *_PLAIN_KEYS, F.array_join("requirements", " ").alias("requirements"), size)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack each file, and a note beside it, into a gzipped tar archive; every ninth archive is cut short as well."""
    for batch in batches:
        names, packs = [], []
        for i, path, content in zip(*(c.to_pylist() for c in batch.columns)):
            data = io.BytesIO()
            with tarfile.open(fileobj=data, mode="w:gz") as tar:
                for name, body in (("notes.txt", b"none"), (path or "none.tex", content.encode()), ("bad.tex", b"\xff\xfe")):
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
            names.append(str(i))
            packs.append(data.getvalue())
            if i % 9 == 0:
                names.append(f"broken-{i}")
                packs.append(b"no archive")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packs, pa.binary())], ["archive", "content"])


@query(
    "SELECT CAST(file_id AS VARCHAR) AS archive, 0 AS ord, coalesce(target_file || '.tex', 'none.tex') AS path, content FROM github_crawler WHERE content IS NOT NULL"
    " UNION ALL SELECT CAST(file_id AS VARCHAR), 1, 'bad.tex', NULL FROM github_crawler WHERE content IS NOT NULL"
)
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources in archives: other members are left out, one that is no text is null, a broken archive gives nothing."""
    rows = read(spark, sf_dir, "github_crawler").filter("content is not null")
    packs = rows.select("file_id", F.concat("target_file", F.lit(".tex")).alias("path"), "content").mapInArrow(_packed, "archive string, content binary")
    return files.unpacked(packs)


_LANGUAGES = ", ".join(_quoted(x) for x in web.ENCYCLOPEDIA_HOSTS)


@query(f"SELECT language, title, rc_timestamp AS timestamp FROM wikipedia_crawler WHERE language IN ({_LANGUAGES})")
def recent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of all languages, read page by page from recorded answers by their continuations, a task for each language."""
    path = new_path(spark, "answers")
    pages = read(spark, sf_dir, "wikipedia_crawler").filter(F.col("language").isin(list(web.ENCYCLOPEDIA_HOSTS)))
    change = F.struct("title", F.col("rc_timestamp").alias("timestamp"))
    answers = pages.groupBy("language", F.expr("page_id div 500").alias("page")).agg(F.collect_list(change).alias("recentchanges"))
    in_order = Window.partitionBy("language").orderBy("page")
    follow = F.lead("page").over(in_order)
    body = F.struct(
        F.struct("recentchanges").alias("query"), F.when(follow.isNotNull(), F.struct(follow.cast("string").alias("rccontinue"))).alias("continue")
    )
    params = sites.LISTING | {"rcstart": "a", "rcend": "b", "rclimit": "500"}
    first = F.create_map(*(F.lit(x) for k, v in web.ENCYCLOPEDIA_HOSTS.items() for x in (k, sites.Request(v, params).address)))
    token = F.when(F.row_number().over(in_order) > 1, F.concat(F.lit("&rccontinue="), F.col("page"))).otherwise("")
    answers.select(F.concat(first[F.col("language")], token).alias("address"), F.lit(200).alias("status"), F.to_json(body).alias("body")).write.parquet(path)
    web.register(spark)
    listing = spark.read.format("paged").schema("language string, title string, timestamp string")
    options = {"transport": "tessera.sources.sites:new_pages", "answers": path, "partitions": json.dumps(list(web.ENCYCLOPEDIA_HOSTS)), "start": "a", "end": "b"}
    return listing.options(**options).load()


@query("SELECT article_id, '/works/' || article_id || '/chapters/' || length(url) AS link FROM bbc_crawler WHERE url IS NOT NULL")
def work_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links to works of listings, among bookmarks, collections, queries and places outside the list."""
    n = F.col("article_id").cast("string")
    a = lambda *x: F.concat(F.lit('<a href="'), *x, F.lit('">x</a>'))
    work = F.concat(F.lit("/works/"), n)
    html = F.concat(
        F.lit('<a href="/works/1">top</a><ol class="work index group"><li class="work blurb group">'),
        a(work, F.lit("/chapters/"), F.length("url").cast("string")), a(work, F.lit("/bookmarks")), a(work, F.lit("/collections")),
        a(work, F.lit("?view=all")), a(work, F.lit("#comments")), a(F.lit("/users/"), n), F.lit("</li><li class='own'>"), a(work), F.lit("</li></ol>"),
    )
    pages = read(spark, sf_dir, "bbc_crawler").filter("url is not null")
    return pages.select("article_id", F.explode(H.over(H.work_links, html)).alias("link"))


_PARAGRAPHS = "list_filter(string_split(extracted_contents, chr(10)), lambda x: trim(x, ' ') <> '')"


@query(
    f"SELECT article_id, CAST(len({_PARAGRAPHS}) AS INT) AS paragraphs, CAST(list_sum(list_transform({_PARAGRAPHS}, lambda x: length(x))) AS BIGINT) AS chars"
    f" FROM bbc_crawler WHERE extracted_contents IS NOT NULL AND len({_PARAGRAPHS}) > 0"
)
def work_paragraph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of works: of the whole work where there is one, else of the first chapter."""
    lines = F.filter(F.split("extracted_contents", "\n"), lambda x: F.trim(x) != "")
    body = F.concat(F.lit("<p>"), F.array_join(F.transform(lines, _escaped), "</p><p>"), F.lit("</p>"))
    whole = F.concat(F.lit('<div id="chapters"><div class="userstuff">'), body, F.lit('</div></div><div id="x"><p>note</p></div>'))
    first = F.concat(F.lit('<div id="chapter-1"><p>summary</p><div class="userstuff module">'), body, F.lit("</div></div>"))
    html = F.when(F.col("article_id") % 2 == 0, whole).otherwise(first)
    pages = spread(read(spark, sf_dir, "bbc_crawler").select("article_id", "extracted_contents").filter("extracted_contents is not null"))
    found = pages.filter(F.size(lines) > 0).select("article_id", H.over(H.work_paragraphs, html).alias("p"))
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return found.select("article_id", F.size("p").alias("paragraphs"), chars.alias("chars"))


@query("SELECT page_id, 'https://papers.example/src/' || page_id AS link FROM wikipedia_crawler WHERE title IS NOT NULL")
def result_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source archives of a result list, from its links named pdf."""
    n = F.col("page_id").cast("string")
    link = lambda kind, name: F.concat(F.lit(f'<a href="https://papers.example/{kind}/'), n, F.lit(f'">{name}</a>'))
    html = F.concat(
        link("pdf", "pdf"), F.lit('<ol><li class="arxiv-result">'), link("abs", "abs"), link("pdf", "pdf"), link("ps", "ps"), F.lit("<p>"),
        _escaped(F.col("title")), F.lit("</p></li></ol>"),
    )
    pages = read(spark, sf_dir, "wikipedia_crawler").filter("title is not null")
    return pages.select("page_id", F.explode(H.over(H.source_links, html)).alias("link"))


@query("SELECT data_path, replace(replace(data_path, '.json', ''), '_', '_' || chr(8203)) AS label FROM run_log WHERE data_path IS NOT NULL")
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of data sets as headers of a table."""
    return read(spark, sf_dir, "run_log").filter("data_path is not null").select("data_path", T.header_label(F.col("data_path")).alias("label"))


#: ``repr`` in SQL, for texts whose only characters that need an escape are these; others are counted by code point.
_REPR = (
    "strlen(text) + 2 + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, chr(10), '')))"
    " + (length(text) - length(replace(text, chr(9), ''))) + (length(text) - length(replace(text, chr(13), '')))"
    " + CASE WHEN contains(text, chr(39)) AND contains(text, chr(34)) THEN length(text) - length(replace(text, chr(39), '')) ELSE 0 END"
    " + list_sum(list_transform(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{80}-\\x{a0}\\x{ad}]'), lambda x: 4 - strlen(x)))"
    " + list_sum(list_transform(regexp_extract_all(text, '[\\x{1680}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}]'), lambda x: 6 - strlen(x)))"
)


@query(f"SELECT doc_id, CAST({_REPR.replace('list_sum(', '(SELECT coalesce(sum(v), 0) FROM unnest(').replace(' - strlen(x)))', ' - strlen(x))) t(v))')} AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def repr_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text as Python writes it in a list."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null"))
    return docs.select("doc_id", T.repr_bytes(F.col("text")).alias("size"))


@query(
    "WITH g AS (SELECT source, count(text) AS samples, avg(length(text)) AS chars FROM documents GROUP BY source)"
    " SELECT '<table><caption>Corpora</caption><tr><th>source</th><th>samples</th><th>chars</th></tr>' || string_agg('<tr><td>' || coalesce(source, '') || '</td><td>' ||"
    " samples || '</td><td>' || printf('%.3f', chars) || '</td></tr>', '' ORDER BY source) || '</table>' AS html FROM g"
)
def styled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the corpora as an HTML table."""
    docs = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("text").alias("samples"), F.avg(F.length("text")).alias("chars"))
    return spark.createDataFrame([(R.html_table(docs.orderBy("source"), "Corpora"),)], "html string")


@query("SELECT least(300, count(*)) AS rows, least(300, count(*)) AS texts FROM (SELECT DISTINCT substring(text, 1, 5000) AS text FROM documents WHERE length(text) > 1000)")
def stream_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples collected by a stream until there are enough."""
    kept = _document_stream(spark, sf_dir).filter("length(text) > 1000").select(F.substring("text", 1, 5000).alias("text"))
    table = run_to_table(distinct_stream(kept, "text"), "enough", 300)
    return table.agg(F.count("*").alias("rows"), F.countDistinct("text").alias("texts"))


@query(
    """WITH t AS (SELECT dataset, doc_id, regexp_extract_all(hex(encode(text)), '..') AS b, strlen(text) AS n, length(text) AS c FROM documents WHERE text IS NOT NULL),
    p AS (SELECT dataset, doc_id, unnest(b[:-2]) AS prev, unnest(b[2:]) AS next, unnest(range(1, len(b))) AS i FROM t WHERE n > 1),
    s AS (SELECT dataset, doc_id, sum(CASE WHEN prev = '20' THEN ln(255 + exp(4)) - CASE WHEN next = '20' THEN 4 ELSE 0 END
        ELSE ln(254 + exp(3) + exp(1)) - CASE WHEN next = '20' THEN 3 WHEN next = prev THEN 1 ELSE 0 END END) AS nll FROM p WHERE i % 512 <> 0 GROUP BY 1, 2)
    SELECT dataset AS data_path, 'local/repeat' AS model, count(*) AS samples, round(avg(n), 4) AS tokens, round(avg(c), 4) AS chars, 2e-9 AS parameters_b,
    round(avg(coalesce(nll, 0)) / avg(n) / ln(2) * 0.125 * 100, 3) AS rate FROM t LEFT JOIN s USING (dataset, doc_id) GROUP BY dataset"""
)
def model_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs of a byte model that repeats itself, scored in padded batches."""
    docs = spread(read(spark, sf_dir, "documents").select("dataset", F.col("doc_id").alias("idx"), "text"))
    config = S.EvaluationConfig("local/repeat", "documents", "repeat", model_args={"space": 3.0}, chunk_size=512, batch_size=8)
    return S.evaluate(docs, config).select(
        "data_path", F.col("model_name_or_path").alias("model"), F.col("sample_count").alias("samples"), F.round("`avg tokens`", 4).alias("tokens"),
        F.round("`avg character count`", 4).alias("chars"), F.col("parameters count").alias("parameters_b"), F.round("compression_rate", 3).alias("rate"),
    )
