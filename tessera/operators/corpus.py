"""Filters, deduplication and limits over samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse_newlines, drop_brackets, letter_count, truncate

#: Lengths for each kind of site: least (exclusive, tested before truncation) and most.
LIMITS = {"encyclopedia": (1000, 5000), "news": (2000, 5000), "papers": (2000, 5000), "code": (1000, 5000)}


def long_enough(df: DataFrame, text: str, least: int, length: str | None = None) -> DataFrame:
    """Keep texts longer than ``least``. A stored ``length`` column, if given, prunes the scan."""
    size = F.length(text) if length is None else F.col(length)
    return df.filter(F.col(text).isNotNull() & (size > least))


def filled(df: DataFrame, text: str) -> DataFrame:
    """Keep texts that are neither null nor empty."""
    return df.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def filter_then_truncate(df: DataFrame, text: str, least: int, most: int, length: str | None = None) -> DataFrame:
    """Keep texts longer than ``least`` and cut them at ``most``."""
    return long_enough(df, text, least, length).withColumn(text, truncate(F.col(text), most))


def truncate_then_filter(df: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """Cut texts at ``most`` and keep those still longer than ``least``."""
    return df.withColumn(text, truncate(F.col(text), most)).filter(F.length(text) > least)


def mostly_letters(df: DataFrame, text: str, begin: int, end: int, share: float = 0.6) -> DataFrame:
    """Keep texts whose ASCII letters exceed a share of the window's nominal size."""
    return df.filter(letter_count(F.col(text)) > share * (end - begin))


def _told_apart(text: str) -> list[Column]:
    """Return what tells texts apart in place of the text: two independent 64- and 128-bit hashes and the length."""
    return [F.xxhash64(text).alias("h1"), F.md5(text).alias("h2"), F.length(text).alias("n")]


def distinct_texts(df: DataFrame, text: str, key: str, *by: str) -> DataFrame:
    """Keep one row of each text, within ``by``: its least ``key``.

    Texts are compared by their hashes, so the shuffle that finds the first of each carries hashes and keys.
    The rows kept are then joined by key; beyond the broadcast limit that join moves each text
    once, to the task of its own key, never to that of an equal text, so copies make no skew.
    """
    marked = df.filter(F.col(text).isNotNull()).select(*by, key, *_told_apart(text))
    first = marked.groupBy(*by, "h1", "h2", "n").agg(F.min(key).alias(key))
    return df.join(first.select(key), key, "left_semi")


def content_hashes(df: DataFrame, text: str, key: str) -> DataFrame:
    """Return (``content_hash``, first ``key``, ``copies``) by hash of the whole text."""
    return (
        df.filter(F.col(text).isNotNull())
        .groupBy(F.sha2(text, 256).alias("content_hash"))
        .agg(F.min(key).alias(key), F.count("*").alias("copies"))
    )


def first_seen(df: DataFrame, values: list[str], order: str) -> DataFrame:
    """Keep each combination of ``values`` once, with its least ``order``."""
    return df.groupBy(*values).agg(F.min(order).alias(order))


def first_index(df: DataFrame, text: str, key: str, *by: str) -> DataFrame:
    """Return for every row the least ``key`` of an equal text within ``by``, as ``first_index``; null texts are equal.

    Hashes stand for the texts: the least key is found by partial aggregation and joined back on
    the hashes, so a frequent text is folded in its tasks and no window holds its rows.
    """
    marked = df.select("*", *(c.alias(f"_{n}") for c, n in zip(_told_apart(text), ("h1", "h2", "n"))))
    names = [*by, "_h1", "_h2", "_n"]
    first = marked.groupBy(*names).agg(F.min(key).alias("first_index"))
    first = first.select("first_index", *(F.col(n).alias(f"_of{i}") for i, n in enumerate(names)))
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_of{i}")) for i, n in enumerate(names)))
    return marked.join(first, same).select(*df.columns, "first_index")


def capped(df: DataFrame, n: int, order: str, *by: str) -> DataFrame:
    """Keep the first ``n`` rows of each group by ``order``; without groups, of all."""
    if not by:
        return df.orderBy(order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def until_empty_pages(pages: DataFrame, by: str, page: str, empty: Column, most: int = 5) -> DataFrame:
    """Keep the pages of each group up to the one that is its ``most``-th empty page, and that one.

    The count of empty pages is not reset by a page that has results.
    """
    before = Window.partitionBy(by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(empty.cast("int")).over(before), F.lit(0))
    return pages.withColumn("_empty", seen).filter(F.col("_empty") < most).drop("_empty")


def main_files(files: DataFrame, archive: str, order: str, path: str, content: str) -> DataFrame:
    """Return the main file of each archive, if it has one.

    By name in a fixed order of priority; else the first that declares a document class; else
    the first that begins a document; else the only one.
    """
    name = F.substring_index(path, "/", -1)
    rank = F.lit(None).cast("int")
    for i, main in reversed(list(enumerate(["main.tex", "paper.tex", "thesis.tex", "dissertation.tex"]))):
        rank = F.when(name == main, i).otherwise(rank)
    rank = F.coalesce(
        rank,
        F.when(F.contains(F.col(content), F.lit("\\documentclass")), 4),
        F.when(F.contains(F.col(content), F.lit("\\begin{document}")), 5),
        F.lit(6),
    )
    best = files.filter(F.endswith(F.col(path), F.lit(".tex"))).groupBy(archive).agg(
        F.min_by(path, F.struct(rank.alias("rank"), F.col(order))).alias(path), F.min(rank).alias("rank"), F.count("*").alias("files")
    )
    return best.filter("rank < 6 or files = 1").select(archive, path)


def random_file(files: DataFrame, group: str, path: str, seed: str = "0") -> DataFrame:
    """Pick one file of each group by a hash of its path and a seed: random, but repeatable."""
    return files.filter(F.col(path).isNotNull()).groupBy(group).agg(
        F.min_by(path, F.struct(F.md5(F.concat_ws("/", F.lit(seed), F.col(group), F.col(path))), F.col(path))).alias(path)
    )


@dataclass(frozen=True)
class CollectSpec:
    """What to collect of one site."""

    dataset: str
    least: int = 1000
    most: int = 5000
    samples: int = 1000
    clean: Literal["encyclopedia", "none"] = "none"
    test_after_cut: bool = False


def collect(df: DataFrame, spec: CollectSpec, text: str, key: str) -> DataFrame:
    """Clean, filter, cut, deduplicate and cap the pages of a site; return samples."""
    if spec.clean == "encyclopedia":
        df = df.withColumn(text, drop_brackets(collapse_newlines(F.col(text))))
    cut = truncate_then_filter if spec.test_after_cut else filter_then_truncate
    kept = distinct_texts(cut(df.select(key, text), text, spec.least, spec.most), text, key)
    return capped(kept, spec.samples, key).select(F.lit(spec.dataset).alias("dataset"), F.col(key).alias("idx"), F.col(text).alias("text"))


def corpus_stats(df: DataFrame, text: str, by: str) -> DataFrame:
    """Count rows, distinct texts, characters and bytes of each corpus."""
    return df.groupBy(by).agg(
        F.count(text).alias("samples"),
        F.countDistinct(F.xxhash64(text), F.md5(text)).alias("unique_texts"),
        F.sum(F.length(text)).alias("total_chars"),
        F.round(F.avg(F.length(text)), 6).alias("avg_chars"),
        F.round(F.avg(F.octet_length(text)), 6).alias("avg_bytes"),
    )
