"""Verified links between texts and the groups they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WordHashes, shingles, similarity
from tessera.plans.shared import discard, written


#: Most bits of the table of wanted ids, 64 to a row of 16 bytes: at most 33 MB.
MOST_BITS = 1 << 27


def _only(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leave out texts that no pair asks for, before they are shuffled.

    The ids asked for are hashed into a bitmap, which is broadcast: 32 bits for each pair, and
    ``MOST_BITS`` at most. A text that shares a bit with one that is asked for comes along and
    finds no partner in the join, so the bound costs time beyond some ten million pairs, and no row.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (32 * pairs.count()).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    word, place = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bitmap = asked.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    held = texts.withColumns({"_word": word, "_place": place}).join(F.broadcast(bitmap), "_word")
    return held.filter(F.call_function("shiftright", F.col("_bits"), F.col("_place")).bitwiseAND(F.lit(1)) == 1).drop("_word", "_place", "_bits")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float, later: DataFrame | None = None) -> DataFrame:
    """Keep the pairs (``a``, ``b``) whose texts reach ``threshold``.

    ``texts`` has ``id`` and ``text``, and so has ``later``, if all texts of ``b`` are there; similarity is that of the sets of runs of ``shingle``
    words. Both texts of a pair meet by two sorted joins, which spill; rows arrive sorted by
    ``a``, so the set of ``a`` is made once for all its partners and nothing but one set is held.
    ``pairs`` is read twice, so it should be a written table.
    """
    texts, later = (_only(x.select("id", "text"), pairs) for x in (texts, texts if later is None else later))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = later.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = (
        pairs.select("a", "b")
        .join(right.hint("merge"), "b")
        .join(left.hint("merge"), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, mine = WordHashes(), None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ta, tb = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i, x in enumerate(a.to_pylist()):
                if x != last:
                    last, mine = x, np.unique(shingles(hashes.of(ta[i].as_py()), shingle))
                other = np.unique(shingles(hashes.of(tb[i].as_py()), shingle))
                keep[i] = similarity(mine, other) >= threshold - 1e-12
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return joined.mapInArrow(check, "a long, b long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Return (``id``, ``root``) for every id of ``links`` (``a``, ``b``); root is the least id.

    Alternating large-star and small-star steps: each takes the least neighbour of every node by
    partial aggregation and joins it back, so a node of any degree is folded in its tasks and its
    edges are never gathered. The edge table is written after every round, which bounds the lineage.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        least = near.join(lowest, "a")
        if large:
            out = least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = least.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = written(links.filter("a <> b").select("a", "b").distinct(), label)
    before = None
    while (now := mark(edges)) != before:
        before = now
        if not now[0]:
            break
        earlier, edges = edges, written(star(star(edges, large=True), large=False), label)
        discard(earlier)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
