"""Registered queries of the training-text problems and, where possible, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boilerplate import main_text, site_lines
from tessera.llm.credentials import credentials, redacted
from tessera.llm.foreign_code import foreign_files
from tessera.llm.history import History
from tessera.llm.language import Model, documents_by_language, fit, labelled_sample, paragraphs, segments
from tessera.llm.leakage import leaks, without_leaks
from tessera.llm.near_duplicates import group_pairs, near_duplicates
from tessera.llm.packing import MOST_CAPACITIES, fill, packed, token_counts
from tessera.plans.shared import new_path, spread, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spread(_read(spark, sf_dir, table).select(*columns))


def _two_tables(spark: SparkSession, sf_dir: str, tables: list[tuple[str, str]], *columns: str) -> DataFrame:
    """Union of two tables with ``uid`` = 2 * id + number of the table."""
    parts = [
        spread(_read(spark, sf_dir, table).select((F.col(key) * 2 + n).alias("uid"), *columns))
        for n, (table, key) in enumerate(tables)
    ]
    return parts[0].unionByName(parts[1])


def _named(tables: list[tuple[str, str]], uid: str) -> F.Column:
    return F.when(F.pmod(F.col(uid), F.lit(2)) == 0, tables[0][0]).otherwise(tables[1][0])


def _id(uid: str) -> F.Column:
    return F.shiftright(F.col(uid), 1)


P1_TABLES = [("bbc_crawler", "article_id"), ("wikipedia_crawler", "page_id")]


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two_tables(spark, sf_dir, P1_TABLES, "content")
    return near_duplicates(both, "uid", "content", shingle=3, threshold=0.7, scope=F.pmod("uid", F.lit(2)))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with the group it belongs to."""
    groups = _p1(spark, sf_dir)
    return groups.select(
        _named(P1_TABLES, "id").alias("crawler"), _id("id").alias("id"), _id("group_id").alias("group_id")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles of one group."""
    groups = _p1(spark, sf_dir)
    return group_pairs(groups).select(
        _named(P1_TABLES, "a").alias("crawler"), _id("a").alias("id_a"), _id("b").alias("id_b")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of credentials."""
    return credentials(_spread(spark, sf_dir, "github_crawler", "file_id", "target_file", "content"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with the credentials masked."""
    return redacted(_spread(spark, sf_dir, "github_crawler", "file_id", "target_file", "content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, third-party or data."""
    return foreign_files(_spread(spark, sf_dir, "github_crawler", "file_id", "html_url", "target_file", "content")).select("file_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of files by reason."""
    found = foreign_files(_spread(spark, sf_dir, "github_crawler", "file_id", "html_url", "target_file", "content"))
    return found.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("files"))


P1_SQL = r"""
WITH RECURSIVE records AS (
  SELECT 'bbc_crawler' AS crawler, article_id AS id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM bbc_crawler
  UNION ALL
  SELECT 'wikipedia_crawler', page_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') FROM wikipedia_crawler),
places AS (SELECT crawler, id, w, unnest(range(1, len(w) - 1)) AS i FROM records WHERE len(w) >= 3),
grams AS (SELECT DISTINCT crawler, id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM places),
sizes AS (SELECT crawler, id, count(*) AS n FROM grams GROUP BY 1, 2),
shared AS (SELECT a.crawler, a.id AS a, b.id AS b, count(*) AS k FROM grams a JOIN grams b
  ON a.crawler = b.crawler AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
links AS (SELECT s.crawler, s.a, s.b FROM shared s JOIN sizes x ON x.crawler = s.crawler AND x.id = s.a
  JOIN sizes y ON y.crawler = s.crawler AND y.id = s.b WHERE s.k >= 0.7 * (x.n + y.n - s.k) - 1e-9),
near AS (SELECT * FROM links UNION ALL SELECT crawler, b, a FROM links),
reach AS (SELECT crawler, a, b FROM near UNION SELECT r.crawler, r.a, n.b FROM reach r JOIN near n ON r.crawler = n.crawler AND r.b = n.a)
"""
P1_FOUND_SQL = P1_SQL + "SELECT crawler, a AS id_a, b AS id_b FROM reach WHERE a < b"
P1_GROUPS_SQL = (
    P1_SQL + "SELECT s.crawler, s.id, least(s.id, coalesce(min(r.b), s.id)) AS group_id FROM sizes s LEFT JOIN reach r"
    " ON r.crawler = s.crawler AND r.a = s.id GROUP BY s.crawler, s.id"
)

P4_TABLES = [("bbc_crawler", "article_id", "extracted_contents"), ("wikipedia_crawler", "page_id", "content")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that belong to the site."""
    parts = [
        site_lines(_spread(spark, sf_dir, table, key, text), key, text).select(
            F.lit(table).alias("crawler"), F.col("id").alias("record_id"), "line_no"
        )
        for table, key, text in P4_TABLES
    ]
    return parts[0].union(parts[1])


def p4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page without the lines of the site."""
    parts = [
        main_text(_spread(spark, sf_dir, table, key, text), key, text).select(
            F.lit(table).alias("crawler"), F.col("id").alias("record_id"), "text", "removed"
        )
        for table, key, text in P4_TABLES
    ]
    return parts[0].union(parts[1])


P5_TABLES = [("bbc_crawler", "article_id"), ("github_crawler", "file_id")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the later batches that repeat an accepted one, batch by batch as they arrive.

    Each check reads the batch and the store that the one before has left.
    """

    def texts(batch: Column, few: bool) -> DataFrame:
        parts = []
        for n, (table, key) in enumerate(P5_TABLES):
            rows = _read(spark, sf_dir, table).filter(batch).select(
                (F.col(key) * 2 + n).alias("id"), F.col("content").alias("text"), F.lit(n).alias("scope")
            )
            parts.append(spread(rows) if few else rows)
        return parts[0].unionByName(parts[1])

    number = F.col("batch_no")
    history = History(spark, new_path(spark, "p5-history"), shingle=3, threshold=0.7)
    history.start(texts(number == 0, True))
    later = [_read(spark, sf_dir, table).filter(number > 0).select(number).distinct() for table, _ in P5_TABLES]
    found = [
        history.check(texts(number == n, True), texts(number <= n, False), n)
        for (n,) in later[0].union(later[1]).distinct().orderBy("batch_no").toLocalIterator()
    ]
    return reduce(DataFrame.unionByName, found, history.nothing()).select(
        _named(P5_TABLES, "id_a").alias("crawler"), _id("id_a").alias("id_a"), _id("id_b").alias("id_b")
    )


#: Decides the linked records one after the other, in order, against the list of those rejected so far.
P5_SQL = r"""
WITH RECURSIVE records AS (
  SELECT 'bbc_crawler' AS crawler, article_id AS id, batch_no, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM bbc_crawler
  UNION ALL
  SELECT 'github_crawler', file_id, batch_no, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') FROM github_crawler),
places AS (SELECT crawler, id, batch_no, w, unnest(range(1, len(w) - 1)) AS i FROM records WHERE len(w) >= 3),
grams AS (SELECT DISTINCT crawler, id, batch_no, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM places),
sizes AS (SELECT crawler, id, count(*) AS n FROM grams GROUP BY 1, 2),
shared AS (SELECT a.crawler, a.id AS a, b.id AS b, count(*) AS k FROM grams a JOIN grams b
  ON a.crawler = b.crawler AND a.g = b.g AND a.id < b.id AND b.batch_no > 0 GROUP BY 1, 2, 3),
links AS (SELECT s.crawler, s.a, s.b FROM shared s JOIN sizes x ON x.crawler = s.crawler AND x.id = s.a
  JOIN sizes y ON y.crawler = s.crawler AND y.id = s.b WHERE s.k >= 0.7 * (x.n + y.n - s.k) - 1e-9),
asked AS (SELECT crawler, b, list(a ORDER BY a) AS before, row_number() OVER (PARTITION BY crawler ORDER BY b) AS turn FROM links GROUP BY 1, 2),
decided AS (
  SELECT crawler, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS rejected, CAST(NULL AS BIGINT) AS id_a, CAST(NULL AS BIGINT) AS id_b
  FROM (SELECT DISTINCT crawler FROM asked)
  UNION ALL
  SELECT d.crawler, q.turn, CASE WHEN q.found IS NULL THEN d.rejected ELSE list_append(d.rejected, q.b) END, q.found, q.b
  FROM decided d, LATERAL (SELECT a.turn, a.b, list_filter(a.before, lambda x: NOT list_contains(d.rejected, x))[1] AS found FROM asked a
    WHERE a.crawler = d.crawler AND a.turn = d.turn + 1) q)
SELECT crawler, id_a, id_b FROM decided WHERE id_a IS NOT NULL
"""


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "window_sizes").select("window_id", "capacity").limit(MOST_CAPACITIES + 1).collect()
    sizes = written(token_counts(_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "p6-sizes")
    return packed(sizes, {r["window_id"]: r["capacity"] for r in rows})


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window and place of every sample for each window size."""
    return _p6(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows of each size are."""
    return fill(_p6(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give away benchmark items."""
    found = leaks(_spread(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents without the passages; a null text marks one to drop."""
    return without_leaks(_spread(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark"))


P7_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
places AS (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
grams AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g FROM places),
items AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE kind = 1)
SELECT d.id AS doc_id, i.item_id
FROM grams d JOIN items i ON d.g = i.g
WHERE d.kind = 0
GROUP BY d.id, i.item_id
HAVING count(*) >= 0.4 * max(i.n) - 1e-9
"""


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    """The documents that hold running text, and the classifiers."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").filter(
        "source is null or not startswith(source, 'github_')"
    )
    return spread(documents), fit(labelled_sample(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs whose language is not the one that the document's label names."""
    wrong = paragraphs(*_p8(spark, sf_dir)).filter("lang <> 'other' and (named is null or lang <> named)")
    return wrong.select("doc_id", "para_no", "lang")


def p8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and ambiguity of each paragraph."""
    return paragraphs(*_p8(spark, sf_dir)).drop("named")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages within paragraphs that mix several."""
    return segments(*_p8(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and ambiguity of each document, null where it holds no running text."""
    documents, model = _p8(spark, sf_dir)
    return documents_by_language(paragraphs(documents, model), _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Return the queries by name."""
    found = [
        p1_found, p1_groups, p2_found, p2_redacted, p3_found, p3_reasons, p4_found, p4_main_text, p5_found,
        p6_packed, p6_fill, p7_found, p7_cleaned, p8_found, p8_paragraphs, p8_segments, p8_documents,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    """Return the SQL of the queries that SQL can express over whole tables in reasonable time."""
    return {"p1_found": P1_FOUND_SQL, "p1_groups": P1_GROUPS_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL}
