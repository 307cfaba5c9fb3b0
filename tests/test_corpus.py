"""Filters, deduplication, limits and statistics."""


from pyspark.sql import functions as F

from tessera.operators import corpus as C


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_order_of_filter_and_cut(spark):
    df = make(spark, ["a" * 10, "a" * 11, "a" * 5, None])
    assert rows(C.filter_then_truncate(df, "t", 10, 4), "id", "t") == [(1, "aaaa")]
    assert rows(C.truncate_then_filter(df, "t", 4, 4), "id") == []
    assert rows(C.truncate_then_filter(df, "t", 4, 6), "id") == [(0,), (1,), (2,)]
    assert rows(C.filled(make(spark, ["", None, " "]), "t"), "id") == [(2,)]


def test_distinct(spark):
    df = make(spark, ["a", "b", "a", "", "", None, "A"])
    kept = C.distinct_texts(df, "t", "id")
    assert rows(kept, "id") == [(0,), (1,), (3,), (6,)]
    assert rows(C.distinct_texts(kept, "t", "id"), "id") == rows(kept, "id")
    assert rows(C.first_index(df.filter("t is not null"), "t", "id"), "id", "first_index") == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 3), (6, 6)]
    assert rows(C.content_hashes(df, "t", "id"), "id", "copies") == [(0, 2), (1, 1), (3, 2), (6, 1)]
    assert C.distinct_texts(df.limit(0), "t", "id").count() == 0


def test_limits(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(5)], "g string, i int")
    assert rows(C.capped(df, 2, "i", "g"), "g", "i") == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert C.capped(df, 3, "i").count() == 3
    pages = spark.createDataFrame([("d", i, n) for i, n in enumerate([1, 0, 0, 2, 0, 0, 0, 3])], "d string, p int, n int")
    assert rows(C.until_empty_pages(pages, "d", "p", F.col("n") == 0), "p") == [(i,) for i in range(7)]


def test_main_files(spark):
    files = [
        ("a", 0, "x/paper.tex", ""), ("a", 1, "main.tex", ""), ("b", 0, "u.tex", ""), ("b", 1, "v.tex", "\\documentclass"),
        ("c", 0, "u.tex", "\\begin{document}"), ("c", 1, "v.tex", ""), ("d", 0, "only.tex", ""), ("e", 0, "u.tex", ""), ("e", 1, "v.tex", ""), ("f", 0, "n.txt", ""),
    ]
    df = spark.createDataFrame(files, "archive string, ord int, path string, content string")
    assert rows(C.main_files(df, "archive", "ord", "path", "content"), "archive", "path") == [
        ("a", "main.tex"), ("b", "v.tex"), ("c", "u.tex"), ("d", "only.tex"),
    ]
    one = C.random_file(df, "archive", "path", "s")
    assert rows(one, "archive", "path") == rows(C.random_file(df.repartition(3), "archive", "path", "s"), "archive", "path")


def test_collect_and_stats(spark):
    texts = ["x" * 30, "x" * 40, "a\n\n\nb [1] " + "y" * 30, "short", None]
    got = C.collect(make(spark, texts), C.CollectSpec("site", 20, 25, 10, "encyclopedia"), "t", "id")
    assert rows(got, "dataset", "idx") == [("site", 0), ("site", 2)]
    assert all(len(r["text"]) <= 25 for r in got.collect())
    df = spark.createDataFrame([("s", "é"), ("s", "é"), ("s", "ab"), ("s", None)], "g string, t string")
    assert rows(C.corpus_stats(df, "t", "g"), "samples", "unique_texts", "total_chars", "avg_bytes") == [(3, 2, 4, 2.0)]


def test_letters(spark):
    df = make(spark, ["abc1", "ab", "1234"])
    assert rows(C.mostly_letters(df, "t", 0, 4), "id") == [(0,)]
