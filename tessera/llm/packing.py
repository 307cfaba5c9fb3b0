"""Problem 6: samples of varying length into windows of fixed capacity.

Hierarchical packing over the histogram of lengths. Items are routed by length to tiers of
context sizes (the given capacities up to that of the windows, half and a quarter of the least). From the longest tier to the
shortest, a tier's items first fill the gaps that windows of longer tiers have left, the widest gap
first and each with the longest item that fits; what remains of the tier is packed for itself, best
fit decreasing, into windows whose gaps the shorter tiers fill in turn. Windows are dealt to
step groups by their attention cost (the sum of squared lengths), so that steps cost alike.

A plan needs no more than the number of items of each length, at most ``capacity`` counts, so it
is computed at once on the driver for any number of samples; its size is bounded by the
capacity, not by the data. Samples then find their place by rank among those of equal length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary expects text to be cut before merging; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Samples of one length are ranked in buckets: 64, and more so that a bucket takes some ``RANKED`` rows.
BUCKETS, RANKED = 64, 500_000
MOST_CAPACITIES = 64


def token_counts(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Return (``id``, ``n_tokens``) by the tokenizer in the file ``tokenizer``; 0 for null texts.

    The vocabulary, a file of fixed size below 1 MB, is sent to the workers by broadcast.
    """
    with open(tokenizer, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("samples", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    return documents.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        count, "id long, n_tokens long"
    )


class Runs:
    """Runs of windows by the width of their gap."""

    def __init__(self) -> None:
        self.gaps: dict[int, list[tuple[int, int, int]]] = {}
        self.open: list[int] = []

    def put(self, gap: int, run: tuple[int, int, int]) -> None:
        """Add a run."""
        if gap not in self.gaps:
            self.gaps[gap] = []
            insort(self.open, gap)
        self.gaps[gap].append(run)

    def take(self, gap: int) -> tuple[int, int, int]:
        """Take out a run of a gap."""
        run = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            self.open.pop(bisect_left(self.open, gap))
        return run

    def join(self, other: "Runs") -> None:
        """Add all runs of ``other``."""
        for gap, runs in other.gaps.items():
            for run in runs:
                self.put(gap, run)


class Plan:
    """Where the k-th item of each length goes.

    A run is a range of windows that have been filled alike: (first window, number, cost), cost
    being the attention of a window, the sum of its squared lengths. A step of the plan puts
    consecutive items of one length into consecutive windows of one run.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, tiers: list[int], per_step: int) -> None:
        self.capacity, self.windows = capacity, 0
        self.left = {length: n for length, n in histogram.items() if n}
        self.done = dict.fromkeys(self.left, 0)
        self.steps: list[tuple[int, int, int, int]] = []
        self.longer = Runs()
        bounds = sorted({t for t in tiers if t < capacity} | {0, capacity})
        for low, high in list(zip(bounds, bounds[1:]))[::-1]:
            lengths = sorted(x for x in self.left if low < x <= high)
            self._fill(lengths)
            self._pack(lengths)
        self._balance(per_step)

    def _put(self, runs: "Runs", gap: int, run: tuple[int, int, int], length: int, windows: int) -> None:
        """Put an item of a length into the first windows of a run taken from ``runs``, and the rest back."""
        start, size, cost = run
        if windows < size:
            runs.put(gap, (start + windows, size - windows, cost))
        runs.put(gap - length, (start, windows, cost + length * length))
        self.steps.append((length, self.done[length], start, self.capacity - gap))
        self.done[length] += windows
        self.left[length] -= windows

    def _fill(self, lengths: list[int]) -> None:
        """Fill the gaps of the windows of longer tiers, the widest first, each with the longest item that fits."""
        lengths, closed = list(lengths), Runs()
        while self.longer.open and lengths:
            gap = self.longer.open[-1]
            at = bisect_right(lengths, gap)
            run = self.longer.take(gap)
            if not at:
                closed.put(gap, run)
                continue
            length = lengths[at - 1]
            self._put(self.longer, gap, run, length, min(run[1], self.left[length]))
            if not self.left[length]:
                lengths.pop(at - 1)
        self.longer.join(closed)

    def _pack(self, lengths: list[int]) -> None:
        """Pack what is left of a tier into windows of its own, each item into the narrowest gap that takes it."""
        own = Runs()
        for length in reversed(lengths):
            while self.left[length]:
                at = bisect_left(own.open, length)
                if at < len(own.open):
                    gap = own.open[at]
                    run = own.take(gap)
                else:
                    gap = self.capacity
                    run = (self.windows, -(-self.left[length] // (self.capacity // length)), 0)
                    self.windows += run[1]
                self._put(own, gap, run, length, min(run[1], self.left[length]))
        self.longer.join(own)

    def _balance(self, per_step: int) -> None:
        """Order windows by attention, then by fill, and deal them to step groups to and fro."""
        runs = sorted((-cost, gap, start, size) for gap, own in self.longer.gaps.items() for start, size, cost in own)
        sizes = np.array([r[3] for r in runs], np.int64)
        starts = np.array([r[2] for r in runs], np.int64)
        ranks = np.cumsum(sizes) - sizes
        order = np.argsort(starts)
        self.run_starts, self.run_ranks = starts[order], ranks[order]
        self.groups = max(1, -(-self.windows // per_step))
        steps = np.array(sorted(self.steps), np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.starts, self.offsets = steps.T

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return window, offset and step group of items given by length and rank."""
        first = np.searchsorted(self.lengths, lengths, "left")
        last = np.searchsorted(self.lengths, lengths, "right")
        at = np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = lengths == length
            a, b = first[own][0], last[own][0]
            at[own] = a + np.searchsorted(self.ranks[a:b], ranks[own], "right") - 1
        window = self.starts[at] + ranks - self.ranks[at]
        run = np.searchsorted(self.run_starts, window, "right") - 1
        order = self.run_ranks[run] + window - self.run_starts[run]
        row, place = order // self.groups, order % self.groups
        return window, self.offsets[at], np.where(row % 2 == 0, place, self.groups - 1 - place)


PACKED = (
    "window_id int, capacity long, id long, piece_no int, from_token long, n_tokens long, "
    "window_no long, offset long, step_no long"
)


def packed(sizes: DataFrame, capacities: dict[int, int], per_step: int = 8) -> DataFrame:
    """Return the place of every piece of every sample, for the windows of each capacity.

    ``sizes`` has ``id`` (unique) and ``n_tokens``; ``capacities`` maps window ids to tokens.
    A sample above the capacity is split into full windows and a rest; no other is split.
    A sample of 0 tokens, or of null size, takes no space: its window, offset and step are
    null. Ties of equal length are ordered by a hash of the id and then by the id. No sizes or
    no capacities give an empty result.
    """
    spark = sizes.sparkSession
    if len(capacities) > MOST_CAPACITIES or any(c <= 0 for c in capacities.values()):
        raise ValueError("capacities must be positive and few")
    if not capacities:
        return spark.createDataFrame([], PACKED)
    kinds = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in capacities.items())))
    whole = sizes.select("id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), kinds.alias("k")).select(
        "id", "n", F.col("k.w").cast("int").alias("window_id"), F.col("k.c").cast("long").alias("capacity")
    )
    buckets = max(BUCKETS, -(-sizes.count() // RANKED))
    last = F.expr("cast((greatest(n, 1) - 1) div capacity as int)")
    pieces = whole.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "window_id",
        "capacity",
        "id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("from_token"),
        F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"),
        F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    key = ["window_id", "n_tokens", "bucket"]
    counts = written(pieces.groupBy(*key).count(), "p6-counts")
    before = Window.partitionBy("window_id", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    least = min(capacities.values())
    tiers = sorted({*capacities.values(), least // 2, least // 4} - {0})
    plans = {}
    histograms: dict[int, dict[int, int]] = {w: {} for w in capacities}
    for row in counts.groupBy("window_id", "n_tokens").agg(F.sum("count").alias("n")).toLocalIterator():
        if row["n_tokens"]:
            histograms[row["window_id"]][row["n_tokens"]] = row["n"]
    for w, c in capacities.items():
        plans[w] = Plan(histograms[w], c, tiers, per_step)
    sent = spark.sparkContext.broadcast(plans)

    ranked = (
        pieces.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("id", "piece_no")) - 1)
        .join(offsets, key)
        .select(
            "window_id", "capacity", "id", "piece_no", "from_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank")
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for batch in batches:
            kinds, lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 5, 6))
            found = np.zeros((3, len(ranks)), np.int64)
            for w in np.unique(kinds):
                own = (kinds == w) & (lengths > 0)
                if own.any():
                    found[:, own] = plans[int(w)].find(lengths[own], ranks[own])
            rest = [pa.array(x, mask=lengths == 0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], *rest],
                [
                    "window_id", "capacity", "id", "piece_no", "from_token", "n_tokens",
                    "window_no", "offset", "step_no",
                ],
            )

    return ranked.mapInArrow(place, PACKED)


def fill(places: DataFrame) -> DataFrame:
    """Return, for each capacity, the windows used, the tokens in them, the share filled and how steps compare.

    ``token_spread`` and ``cost_spread`` are the standard deviation of the tokens and of the
    attention cost of the step groups, as a share of their mean.
    """
    by_window = places.filter("window_no is not null").groupBy("window_id", "capacity", "window_no", "step_no").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost")
    )
    by_step = by_window.groupBy("window_id", "capacity", "step_no").agg(
        F.count("*").alias("windows"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")
    )
    spread = lambda c: F.round(F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0)), 4)
    return by_step.groupBy("window_id", "capacity").agg(
        F.sum("windows").alias("windows"),
        F.sum("pieces").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.sum("windows") * F.col("capacity")), 6).alias("filled"),
        F.count("*").alias("steps"),
        spread(F.col("tokens")).alias("token_spread"),
        spread(F.col("cost")).alias("cost_spread"),
    )
