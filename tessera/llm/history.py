"""Problem 5: new batches against everything accepted before, by content-defined chunking.

A rolling hash over the words of a text opens a chunk wherever it falls on a multiple of the
text's step, and a chunk is known by the window that opens it. An edit inside a chunk therefore
leaves the chunk known: the chunks of two texts are as similar as the texts on average, while few
chunks are without any edit. The step is a power of two that gives a text 24 to 48 chunks;
a text of fewer than 48 windows has a chunk at each of them, so short texts are compared
exactly. Texts of neighbouring steps meet on the chunks of the greater step.

The history is a store, bucketed by chunk and partitioned by batch: which accepted records hold a
chunk, and which partners it serves. How common a chunk is counts as of the start: a
table of ``SLOTS`` bytes has four steps for each doubling, and chunks that share a slot count as equally common. It
never changes, so the places of chunks in old and new records are comparable; a chunk that turns common
later costs time, and no row.

A batch is chunked alone. The store is not shuffled: it is read in its buckets and streamed past
the batch's chunks. Of the chunks that two records must share to reach the threshold, all but the
rarest two may be left out on either side: a record is stored, and asked for, only by chunks of which one of
these two may be, and a joined row counts only if it may be for both. Pairs that share two such chunks are
compared on their texts, records are decided in order, and the chunks of those accepted are appended. A batch
overwrites its own partition and reads those before it, so a batch that is tried again gives the same store.

Nothing is capped. Chunks of very many holders are spread over several keys, so no task gets all rows
of a stock chunk.

A linked pair is lost only if it shares fewer chunks than ``LOSS`` allows: for either text once in two
million at exactly the threshold. Ids must not fall from one batch to the next: order of arrival is order of id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.links import verified
from tessera.llm.words import WORD, WordHashes, mix, shingles
from tessera.plans.shared import discard, written

#: Chunks of a text: at least so many on average. Holders beyond which a chunk is hot, and by key.
CHUNKS, HOT, SPLIT = 24, 8, 100_000
#: Probability that a pair at the threshold shares fewer chunks than one of its texts asks for. Slots of the order of chunks.
LOSS, SLOTS = 5e-7, 1 << 22
#: Size of the table of least numbers; beyond ``MOST`` chunks, fewer than could be are asked for.
SHARES, MOST = 16, 256
_LEVEL = np.uint64(40)


def step_of(windows: int) -> int:
    """Return the mean distance of chunks, in windows, for a text of so many distinct windows."""
    return 1 if windows < 2 * CHUNKS else 1 << int(math.log2(windows / CHUNKS))


def chunk(grams: np.ndarray, ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return the distinct chunks of a text, their bytes, and whether they also open one at twice the step.

    ``grams`` are the hashes of the windows in order, ``ends`` the bytes up to each word.
    """
    level = grams >> _LEVEL
    starts = np.flatnonzero((level & np.uint64(step - 1)) == 0)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, bool)
    before = np.concatenate([[0], ends])[starts]
    sizes = np.diff(np.append(before, ends[-1]))
    found, at = np.unique(grams[starts], return_inverse=True)
    coarse = ((found >> _LEVEL) & np.uint64(2 * step - 1)) == 0
    return found, np.bincount(at, sizes).astype(np.int32), coarse


def least_shared(chunks: int, share: float) -> int:
    """Return how many of so many chunks are common to texts that share ``share`` of their windows, but for a chance of ``LOSS``."""
    total = 0.0
    for shared in range(chunks + 1):
        total += math.comb(chunks, shared) * share**shared * (1 - share) ** (chunks - shared)
        if total > LOSS:
            return shared
    return chunks


@lru_cache(maxsize=4)
def needed(threshold: float) -> np.ndarray:
    """Return ``least_shared`` by share, from the threshold to 1, and by number of chunks."""
    shares = [threshold + (1 - threshold) * i / SHARES for i in range(SHARES)]
    return np.array([[least_shared(k, share) for k in range(MOST + 1)] for share in shares])


def most_windows(threshold: float, windows: int, chunks: int, shared: np.ndarray, exact: bool = False) -> np.ndarray:
    """Return the windows up to which a partner needs no more than ``shared`` common chunks, 0 if none.

    ``chunks`` is how many the text has at the step of the pair; with ``exact`` every window is one.
    """
    part = threshold / (1 + threshold)
    if exact:
        return np.minimum(shared / part - windows, windows / threshold) + 1e-6
    places = np.searchsorted(needed(threshold)[:, min(chunks, MOST)], shared, "right")
    below = windows * ((threshold + (1 - threshold) * places / SHARES) / part - 1)
    return np.where(places == 0, 0, np.minimum(np.where(places == SHARES, np.inf, below), windows / threshold) + 1e-6)


CLASSES = "id long, same_a long, same_b long, windows int, step int, chunks array<long>, coarse array<boolean>"
ROWS = "chunk long, id long, windows int, coarse_from int, most int, coarse_most int, thin int, parts int"


def chunked(texts: DataFrame, shingle: int) -> DataFrame:
    """Return the class and the chunks of each text that has a window of ``shingle`` words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows, chunks, coarse = [], [], []
                for i, text, scope in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    words = WORD.findall(text.as_py().lower())
                    grams = shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), shingle)
                    if not len(grams):
                        continue
                    bare = words if text.as_py().isascii() else [w.encode("utf-8", "replace") for w in words]
                    ends = np.cumsum(np.fromiter(map(len, bare), np.int64, len(words)))
                    distinct = np.unique(grams)
                    step = step_of(len(distinct))
                    found, _, both = chunk(grams, ends, step)
                    salt = mix(np.array([scope], np.int64).view(np.uint64))[0]
                    rows.append(
                        (
                            i,
                            int((distinct.sum(dtype=np.uint64) ^ salt).view(np.int64)),
                            int((mix(distinct).sum(dtype=np.uint64) + np.uint64(len(distinct))).view(np.int64)),
                            len(distinct),
                            step,
                        )
                    )
                    chunks.append(found ^ salt)
                    coarse.append(both)
                if not rows:
                    continue
                ends = pa.array(np.cumsum([0, *map(len, chunks)]).astype(np.int32))
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                    + [
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(chunks).view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(coarse))),
                    ],
                    [part.split()[0] for part in CLASSES.split(", ")],
                )

    return texts.select("id", "text", "scope").filter("text is not null").mapInArrow(make, CLASSES)


def ordered(counted: DataFrame) -> DataFrame:
    """Return one row with a byte for each of ``SLOTS``: how common the commonest of its chunks is, 0 if none is hot.

    A slot has four steps for each doubling of the holders (``chunk``, ``n``).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.zeros(SLOTS, np.uint8)
        for batch in batches:
            slots = slots_of(batch.column(0).to_numpy())
            np.maximum.at(order, slots, (4 * np.log2(batch.column(1).to_numpy())).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([order.tobytes()])], ["slots"])

    return counted.coalesce(1).mapInArrow(make, "slots binary")


def slots_of(chunks: np.ndarray) -> np.ndarray:
    """Return the slot of each chunk in the order of the store."""
    return (mix(chunks.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def chunk_rows(records: DataFrame, slots: Broadcast, threshold: float) -> DataFrame:
    """Return a row for each chunk by which a record may be found, with the windows of the partners it serves.

    The place of a chunk is the number of chunks of its record that are as common or commoner. If two
    records share k chunks, the second rarest of those is at least in place k - 1 of both, so a chunk in a place
    serves only partners that need not share more than one chunk above it: up to ``most`` windows, and ``coarse_most`` from
    ``coarse_from`` on, where the partner has the greater step. ``thin``: one chunk is enough for partners of the own
    or a smaller step (1), of the greater one (2). ``parts`` is over how many keys the rows of the chunk are spread.
    """
    split = SPLIT

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(slots.value, np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = []
                chunks, coarse = (x.flatten().to_numpy(zero_copy_only=False) for x in batch.columns[3:])
                levels = order[slots_of(chunks)]
                ends = np.cumsum([0, *batch.column(3).value_lengths().to_pylist()])
                for r, (i, windows, step) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:3]))):
                    own = slice(ends[r], ends[r + 1])
                    by_heat = np.lexsort((chunks[own], -levels[own].astype(int)))
                    found, both, level = chunks[own][by_heat], coarse[own][by_heat], levels[own][by_heat]
                    places, coarse_places = np.arange(1, len(found) + 1), np.cumsum(both)
                    coarse_from, rough = 2 * CHUNKS * step, int(both.sum())
                    most = most_windows(threshold, windows, len(found), places + 1, windows < 2 * CHUNKS).astype(int)
                    coarse_most = np.where(both, most_windows(threshold, windows, rough, coarse_places + 1), 0).astype(int)
                    alone = [
                        most_windows(threshold, windows, len(found), np.array([1]), windows < 2 * CHUNKS)[0] >= threshold * windows,
                        most_windows(threshold, windows, rough, np.array([1]))[0] >= coarse_from,
                    ]
                    keep = (most >= threshold * windows - 1e-6) | (coarse_most >= coarse_from)
                    parts = 1 + (np.exp2((level[keep] + 1) / 4) / split).astype(int)
                    n = len(parts)
                    constant = [np.full(n, x) for x in (i, windows, coarse_from, alone[0] + 2 * alone[1])]
                    out.append([found[keep], *constant[:3], most[keep], coarse_most[keep], constant[3], parts])
                if out:
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).astype(kind.to_pandas_dtype()), kind) for x, kind in zip(zip(*out), kinds)],
                        [part.split()[0] for part in ROWS.split(", ")],
                    )

    return records.select("id", "windows", "step", "chunks", "coarse").mapInArrow(make, ROWS)


def key(chunk: Column, part: Column) -> Column:
    """Return the key of a part of a chunk's rows; that of part 0 is the chunk itself."""
    return F.when(part == 0, chunk).otherwise(F.xxhash64(chunk, part))


class History:
    """The accepted records, in tables under ``path`` that outlive the session.

    ``start`` accepts a whole table; ``check`` decides a batch and appends what it accepts.
    Null texts and texts of fewer than ``shingle`` words are accepted and resemble nothing.
    Only texts of equal ``scope`` (an integer) are compared. Ids are unique; repeated texts, ties and
    other columns make no difference. Empty batches give an empty result. ``buckets`` is fixed when
    the store is made (a thousand or more for a large history) and read back afterwards.
    """

    TABLES = {"chunks": ("key", "key long, id long, windows int, coarse_from int, most int, coarse_most int, thin int")}

    def __init__(self, spark: SparkSession, path: str, shingle: int = 5, threshold: float = 0.8, buckets: int | None = None) -> None:
        self.spark, self.path, self.shingle, self.threshold = spark, path, shingle, threshold
        settings = f"{path}/settings"
        try:
            self.buckets, made = spark.read.schema("buckets int").json(settings).first()[0], True
        except AnalysisException:
            made = False
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1, numPartitions=1).select(F.lit(self.buckets).alias("buckets")).write.json(settings)
        self.slots: Broadcast | None = None
        self.prefix = f"history_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        for name, (by, columns) in self.TABLES.items():
            spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
            spark.sql(
                f"CREATE TABLE {self.prefix}_{name} ({columns}, batch int) USING parquet PARTITIONED BY (batch)"
                f" CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'"
            )
            if made:
                spark.sql(f"MSCK REPAIR TABLE {self.prefix}_{name}")

    def nothing(self) -> DataFrame:
        """Return the result of a check that rejects nothing."""
        return self.spark.createDataFrame([], "id_a long, id_b long")

    def stored(self, name: str, before: int) -> DataFrame:
        """Return a table of the store as it was before a batch."""
        return self.spark.table(f"{self.prefix}_{name}").filter(F.col("batch") < before)

    def _append(self, rows: DataFrame, batch: int) -> None:
        """Write the chunks that a batch adds to the store, one file for each bucket."""
        by, columns = self.TABLES["chunks"]
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        rows = rows.withColumn("key", key(F.col("chunk"), part)).select(*(part.split()[0] for part in columns.split(", ")))
        rows.repartition(self.buckets, by).createOrReplaceTempView("history_rows")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.prefix}_chunks PARTITION (batch = {int(batch)}) SELECT * FROM history_rows")

    def _slots(self) -> Broadcast:
        """Return the order of chunks that was fixed at the start of the store."""
        if self.slots is None:
            try:
                row = self.spark.read.schema("slots binary").parquet(f"{self.path}/order").first()
            except AnalysisException:
                row = None
            self.slots = self.spark.sparkContext.broadcast(row[0] if row else bytes(SLOTS))
        return self.slots

    def _members(self, made: DataFrame) -> DataFrame:
        """Return (``id``, ``class_id``) of all records; a class is known by its first record."""
        first = made.groupBy("same_a", "same_b").agg(F.min("id").alias("class_id"))
        return made.select("id", "same_a", "same_b").join(first, ["same_a", "same_b"]).select("id", "class_id")

    def start(self, texts: DataFrame, batch: int = 0) -> None:
        """Accept all of ``texts`` (``id``, ``text``, ``scope``) as the history, its batch ``batch``."""
        made = written(chunked(texts, self.shingle), "p5-chunked")
        counted = made.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
        ordered(counted.filter(F.col("n") > HOT)).write.mode("overwrite").parquet(f"{self.path}/order")
        first = made.groupBy("same_a", "same_b").agg(F.min("id").alias("id")).select("id")
        self._append(chunk_rows(made.join(first, "id", "left_semi"), self._slots(), self.threshold), batch)
        discard(made)

    def check(self, texts: DataFrame, corpus: DataFrame, batch: int) -> DataFrame:
        """Decide the records of a batch; return (``id_a``, ``id_b``) for each one rejected.

        ``id_b`` is the rejected record and ``id_a`` the least id of the accepted records
        before it that reach the threshold. ``corpus`` (``id``, ``text``) has the texts of
        this batch and of the history; only those of candidates leave its scan. Batches are
        checked in order of their number.
        """
        made = written(chunked(texts, self.shingle), "p5-chunked")
        members = written(self._members(made), "p5-members")
        classes = members.filter("id = class_id").select("id")
        rows = written(chunk_rows(made.join(classes, "id", "left_semi"), self._slots(), self.threshold), "p5-rows")
        discard(made)
        pairs = written(self._candidates(rows, batch), "p5-pairs")
        links = written(verified(pairs, corpus, self.shingle, self.threshold, texts), "p5-links")
        decided = written(self._decide(links, classes), "p5-decided")
        self._append(rows.join(decided.filter("least is null").select("id"), "id", "left_semi"), batch)
        discard(rows)
        return (
            members.join(decided.withColumnRenamed("id", "class_id"), "class_id")
            .select(F.coalesce("least", "class_id").alias("id_a"), F.col("id").alias("id_b"))
            .filter("id_a < id_b")
        )

    def _candidates(self, rows: DataFrame, batch: int) -> DataFrame:
        """Return the pairs (``a`` < ``b``), ``b`` of the batch, that share two chunks which serve both, or one if no more is needed."""
        bounds = ["windows", "coarse_from", "most", "coarse_most", "thin"]

        def side(df: DataFrame, by: str, which: str) -> DataFrame:
            return df.select(by, F.col("id").alias(which), *(F.col(x).alias(f"{x}_{which}") for x in bounds))

        def met(df: DataFrame) -> DataFrame:
            return df.filter(
                "a < b and windows_a <= if(windows_a >= coarse_from_b, coarse_most_b, most_b)"
                " and windows_b <= if(windows_b >= coarse_from_a, coarse_most_a, most_a)"
            ).select("a", "b", F.expr(
                "(thin_a & if(windows_b >= coarse_from_a, 2, 1)) > 0 and (thin_b & if(windows_a >= coarse_from_b, 2, 1)) > 0"
            ).alias("alone"))

        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        probes = side(rows.select("*", parts).withColumn("key", key(F.col("chunk"), F.col("part"))), "key", "b")
        old = met(side(self.stored("chunks", batch), "key", "a").join(probes.hint("shuffle_hash"), "key"))
        fresh = met(side(rows, "chunk", "a").hint("merge").join(side(rows, "chunk", "b"), "chunk"))
        totals = old.unionByName(fresh).groupBy("a", "b").agg(F.count("*").alias("shared"), F.bool_or("alone").alias("alone"))
        return totals.filter("shared > 1 or alone").select("a", "b")

    def _decide(self, links: DataFrame, batch: DataFrame) -> DataFrame:
        """Return (``id``, ``least``) for the classes of the batch; ``least`` is null if accepted.

        A record is rejected once one linked record before it is accepted, and accepted once
        all of them are rejected. Records without a link before them are accepted from the start,
        which settles most others at once. Each round settles every record whose predecessors are
        settled; the table of states is written after each round.
        """
        state = F.col("state")
        settled = F.when(F.max(F.coalesce(state, F.lit("in")) == "in"), "out").when(F.min(F.coalesce(state, F.lit("in")) == "out"), "in").otherwise("open")
        waiting = links.select(F.col("b").alias("a"), F.lit("open").alias("state")).distinct()
        states = written(links.join(waiting, "a", "left").groupBy(F.col("b").alias("id")).agg(settled.alias("state")), "p5-states")
        while not states.filter("state = 'open'").isEmpty():
            known = links.join(states.withColumnRenamed("id", "a"), "a", "left")
            seen = known.groupBy(F.col("b").alias("id")).agg(settled.alias("next"))
            earlier, states = states, written(
                states.join(seen, "id").select("id", F.when(state == "open", F.col("next")).otherwise(state).alias("state")), "p5-states"
            )
            discard(earlier)
        accepted = links.join(states.withColumnRenamed("id", "a"), "a", "left").filter(
            F.coalesce("state", F.lit("in")) == "in"
        )
        least = accepted.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("least"))
        return batch.join(least, "id", "left")
