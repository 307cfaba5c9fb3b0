"""Problem 1: groups of near-duplicate texts, by Golay-code fuzzy hashing.

1. Sketch. A text becomes the set of its word shingles; 146 minhash functions over the set
   give 18 anchors (the shingle with the least value) and 128 fingerprint bits (one bit of
   the least value). Two texts of similarity J differ in a bit with probability (1 - J) / 2.
2. Keys. The bits are laid out as 18 segments of 23. Each segment is decoded with the perfect
   Golay code (23, 12, 7) at every word within distance 1 of it, which gives one or six
   codeword indices; two segments with at most two differing bits always share an index. By
   the pigeonhole principle, 18 segments with fewer than 54 errors in all have such a
   segment. A key is (segment, anchor of the segment, index): the anchor keeps unrelated
   texts of a large collection apart, the index splits the texts behind a popular anchor.
   A pair of similarity 0.7 has a common key with probability 0.9998 (measured), one of 0.75 with 0.99999.
3. Join and verify. Texts with the same shingle set are first folded into one representative.
   Texts that share a key, and whose 128 fingerprint bits do not rule out the threshold (less
   than one linked pair in 10^7 fails that at 0.7), are compared on their whole shingle sets.
4. Groups are the connected components of the verified links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.links import components, verified
from tessera.llm.words import WordHashes, mix, shingles
from tessera.plans.shared import written

SEGMENTS, BITS, FUNCTIONS, BLOCK = 18, 23, 146, 8192
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


class Golay:
    """Nearest-codeword decoding of 23-bit words; every word is within distance 3 of one."""

    def __init__(self) -> None:
        self.error = np.zeros(2048, np.int32)
        for weight in range(4):
            for places in itertools.combinations(range(BITS), weight):
                e = sum(1 << i for i in places)
                self.error[_remainder(e)] = e
        self.low = np.array([_remainder(v) for v in range(4096)], np.int32)
        self.high = np.array([_remainder(v << 12) for v in range(2048)], np.int32)
        self.ball = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int32)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Return the 12-bit message of the codeword nearest to each word."""
        return (words ^ self.error[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Return, on a new last axis and sorted, the indices of all words within distance 1."""
        return np.sort(self.index(words[..., None] ^ self.ball), axis=-1)


class Sketcher:
    """Anchors, fingerprint bits and their segments, of shingle sets."""

    def __init__(self, seed: int = 20240501) -> None:
        rng = np.random.default_rng(seed)
        self.times = rng.integers(0, 1 << 31, FUNCTIONS, np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 1 << 32, FUNCTIONS, np.uint32)
        pool = np.concatenate([rng.permutation(np.arange(SEGMENTS, FUNCTIONS)) for _ in range(4)])
        self.layout = pool[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
        self.golay = Golay()
        self.segment = mix(np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def least(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the anchors (hashes of shingles) and the least value of every function.

        Long texts are taken in blocks, so memory does not grow with them.
        """
        anchors = least = None
        for start in range(0, len(grams), BLOCK):
            own = grams[start : start + BLOCK]
            x = (own >> np.uint64(32)).astype(np.uint32)
            values = (x[None, :] ^ self.xor[:, None]) * self.times[:, None]
            found, low = own[values[:SEGMENTS].argmin(axis=1)], values.min(axis=1)
            if least is None:
                anchors, least = found, low
            else:
                anchors = np.where(low[:SEGMENTS] < least[:SEGMENTS], found, anchors)
                least = np.minimum(low, least)
        return anchors, least

    def segments(self, values: np.ndarray) -> np.ndarray:
        """Return the fingerprint of each text as words of 23 bits."""
        bits = (values >> np.uint32(13)) & np.uint32(1)
        return (bits[:, self.layout].astype(np.int32) << np.arange(BITS, dtype=np.int32)).sum(axis=2, dtype=np.int32)

    def expand(self, anchors: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return all keys, text by text, and the number of keys of each text."""
        found = self.golay.indices(segments)
        new = np.ones(found.shape, bool)
        new[..., 1:] = found[..., 1:] != found[..., :-1]
        base = anchors ^ self.segment
        keys = mix(base[..., None] + found.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return keys[new].view(np.int64), new.reshape(len(new), -1).sum(axis=1)

    @staticmethod
    def sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return all bits of the fingerprint of each text, as two numbers."""
        bits = ((values[:, SEGMENTS:] >> np.uint32(13)) & np.uint32(1)).astype(np.uint64)
        parts = (bits[:, :64], bits[:, 64:])
        return tuple(
            (b << np.arange(b.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) for b in parts
        )


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """Return (``id``, ``same_a``, ``same_b``, ``print_a``, ``print_b``, ``keys``) for texts with a shingle.

    ``same_a`` and ``same_b`` together identify the scope and the shingle set.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = WordHashes(), Sketcher()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids, scopes, same_a, same_b, anchors, values = [], [], [], [], [], []
                for i, text, scope in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    grams = np.unique(shingles(hashes.of(text.as_py()), shingle))
                    if len(grams):
                        ids.append(i)
                        scopes.append(scope)
                        same_a.append(grams.sum(dtype=np.uint64))
                        same_b.append(mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams)))
                        anchor, value = sketcher.least(grams)
                        anchors.append(anchor)
                        values.append(value)
                if not ids:
                    continue
                salt = mix(np.array(scopes, np.int64).view(np.uint64))
                values = np.array(values)
                flat, counts = sketcher.expand(np.array(anchors) ^ salt[:, None], sketcher.segments(values))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array((np.array(same_a) ^ salt).view(np.int64)),
                        pa.array(np.array(same_b).view(np.int64)),
                        *map(pa.array, sketcher.sketch(values)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["id", "same_a", "same_b", "print_a", "print_b", "keys"],
                )

    return texts.select("id", "text", "scope").filter("text is not null").mapInArrow(
        make, "id long, same_a long, same_b long, print_a long, print_b long, keys array<long>"
    )


def most_errors(threshold: float, bits: int = FUNCTIONS - SEGMENTS) -> int:
    """Return the number of differing fingerprint bits that less than one linked pair in 10^7 exceeds (binomial tail)."""
    p, tail = (1 - threshold) / 2, 1.0
    for errors in range(bits + 1):
        tail -= math.comb(bits, errors) * p**errors * (1 - p) ** (bits - errors)
        if tail < 1e-7:
            return errors
    return bits


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, scope: Column | None = None
) -> DataFrame:
    """Return one row per text that has a shingle: ``id``, ``group_id`` and ``copy_of``.

    ``copy_of`` is the least id with the same shingle set; ``group_id`` the least id of the
    group, its own id for a text alone. Null texts, empty texts and texts of fewer than
    ``shingle`` words give no row. Ids must be unique; repeated texts are folded before any
    comparison. An empty table gives an empty result. Other columns are ignored. Only texts
    of equal ``scope`` (an integer expression) are compared.
    """
    texts = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        (F.lit(0) if scope is None else scope).cast("long").alias("scope"),
    )
    made = written(sketches(texts, shingle), "p1-sketch")
    first = made.groupBy("same_a", "same_b").agg(F.min("id").alias("copy_of"))
    members = written(
        made.select("id", "same_a", "same_b").join(first, ["same_a", "same_b"]).select("id", "copy_of"), "p1-members"
    )
    lone = made.join(members.filter("id = copy_of").select("id"), "id", "left_semi")
    keys = lone.select(F.explode("keys").alias("key"), "id", "print_a", "print_b")
    other = keys.select("key", F.col("id").alias("b"), F.col("print_a").alias("other_a"), F.col("print_b").alias("other_b"))
    errors = "bit_count(print_a ^ other_a) + bit_count(print_b ^ other_b)"
    pairs = (
        keys.withColumnRenamed("id", "a")
        .join(other.hint("merge"), "key")
        .filter(f"a < b and {errors} <= {most_errors(threshold)}")
        .select("a", "b")
        .distinct()
    )
    wanted = written(pairs, "p1-pairs")
    links = verified(wanted, texts, shingle, threshold)
    roots = components(links, "p1-links")
    return members.join(roots.withColumnRenamed("id", "copy_of"), "copy_of", "left").select(
        "id", F.coalesce("root", "copy_of").alias("group_id"), "copy_of"
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """Return every pair (``a`` < ``b``) of ids of one group."""
    left = groups.select("group_id", F.col("id").alias("a"))
    right = groups.select("group_id", F.col("id").alias("b"))
    return left.join(right.hint("merge"), "group_id").filter("a < b").select("a", "b")
