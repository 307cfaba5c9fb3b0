"""Problem 7: passages of held-out items inside training documents.

The distinct word n-grams of all items form one sorted set of hashes. Its size is counted first:
up to ``BROADCAST_GRAMS`` n-grams and ``BROADCAST_BYTES`` of item text it is sent to every task, which
scans each document's windows once against it. A larger set is joined by shuffle with those windows
of the documents that a bitmap of fixed size lets through. Either way, items that enough windows
point to are then compared word for word, which also gives the spans; the scan cuts them out itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WORD, WordHashes, shingles

#: Most n-grams of items (16 bytes each) that are broadcast.
BROADCAST_GRAMS = 2_000_000
#: Most bytes of item text that are broadcast, and bits of the bitmap for larger sets (16 MB).
BROADCAST_BYTES, FILTER_BITS = 64_000_000, 1 << 27
HITS = "doc_id long, item_id long, share double, starts array<int>, ends array<int>"


def grams_of(words: list[str], n: int) -> list[tuple[str, ...]]:
    """Return the runs of ``n`` words in order."""
    return list(zip(*(words[i:] for i in range(n)))) if len(words) >= n else []


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """Return (``item_id``, ``gram``): the distinct n-gram hashes of each item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = np.unique(shingles(hashes.of(text.as_py()), n)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), i, np.int64)), pa.array(grams)], ["item_id", "gram"]
                )

    return items.select("item_id", "text").mapInArrow(make, "item_id long, gram long")


def spans(text: str, wanted: set[tuple[str, ...]], n: int) -> tuple[set, list[tuple[int, int]]]:
    """Return the n-grams of ``text`` that are wanted and the merged character spans they cover."""
    found, covered = set(), []
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    for i, gram in enumerate(grams_of(words, n)):
        if gram in wanted:
            found.add(gram)
            start, end = places[i][0], places[i + n - 1][1]
            if covered and start <= covered[-1][1]:
                covered[-1] = (covered[-1][0], end)
            else:
                covered.append((start, end))
    return found, covered


def _prepared(documents: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple | None]:
    """Return documents, items, their n-grams, and what a scan needs if that may be broadcast."""
    documents = documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    items = items.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    grams = item_grams(items, n)
    held = items.join(grams.select("item_id").distinct(), "item_id", "left_semi")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BROADCAST_BYTES or grams.count() > BROADCAST_GRAMS:
        return documents, held, grams, None
    table = grams.toPandas()
    order = np.argsort(table["gram"].to_numpy().view(np.uint64), kind="stable")
    hashes = table["gram"].to_numpy().view(np.uint64)[order]
    owners = table["item_id"].to_numpy()[order]
    distinct, first = np.unique(hashes, return_index=True)
    texts = {r["item_id"]: r["text"] for r in held.collect()}
    return documents, held, grams, (distinct, first, np.append(first[1:], len(hashes)), owners, texts)


class Scanner:
    """Finds the items of a broadcast table in texts."""

    def __init__(self, table: tuple, n: int, share: float) -> None:
        self.distinct, self.first, self.ends, self.owners, self.texts = table
        self.n, self.share = n, share
        self.sizes = dict(zip(*np.unique(self.owners, return_counts=True)))
        self.exact: dict[int, set] = {}
        self.memory = WordHashes()

    def hits(self, text: str) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """Return (item, share, spans) of each item that ``text`` gives away."""
        windows = shingles(self.memory.of(text), self.n)
        if not len(windows) or not len(self.distinct):
            return []
        at = np.minimum(np.searchsorted(self.distinct, windows), len(self.distinct) - 1)
        found = np.unique(at[self.distinct[at] == windows])
        if not len(found):
            return []
        out = []
        seen = np.concatenate([self.owners[self.first[h] : self.ends[h]] for h in found])
        for item, hit in zip(*np.unique(seen, return_counts=True)):
            if hit >= self.share * self.sizes[item] - 1e-9:
                if item not in self.exact:
                    self.exact[item] = wanted_of(self.texts[item], self.n)
                held = checked(text, self.exact[item], self.n, self.share)
                if held:
                    out.append((int(item), *held))
        return out


def wanted_of(text: str, n: int) -> set[tuple[str, ...]]:
    """Return the distinct n-grams of an item."""
    return set(grams_of([w.lower() for w in WORD.findall(text)], n))


def checked(text: str, wanted: set[tuple[str, ...]], n: int, share: float) -> tuple[float, list[tuple[int, int]]] | None:
    """Return the share of the wanted n-grams in ``text`` and their spans, if the share is enough."""
    found, covered = spans(text, wanted, n)
    if wanted and len(found) >= share * len(wanted) - 1e-9:
        return len(found) / len(wanted), covered
    return None


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    """Return rows (document, item, share, spans) as a batch."""
    out = [(doc, item, part, [a for a, _ in covered], [b for _, b in covered]) for doc, item, part, covered in rows]
    columns = list(zip(*out)) if out else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_id", "item_id", "share", "starts", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def leaks(documents: DataFrame, items: DataFrame, n: int = 5, share: float = 0.4) -> DataFrame:
    """Return one row per document and item of which at least ``share`` of the n-grams occur.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; ids are
    unique and other columns are ignored. ``starts`` and ``ends`` are the character spans
    (from 0, end excluded) in the document. Null texts, empty texts, and items or documents
    of fewer than ``n`` words give no row; items with the same text each give their rows.
    """
    documents, items, grams, table = _prepared(documents, items, n)
    if table is None:
        return _by_join(documents, items, grams, n, share)
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, n, share)
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1))
            yield _hits([(doc, *hit) for doc, text in texts for hit in scanner.hits(text.as_py())])

    return documents.mapInArrow(scan, HITS)


CLEANED = "doc_id long, text string, removed long"


def _cut(text: str, covered: list[tuple[int, int]], most: float) -> tuple[str | None, int]:
    """Return ``text`` without the spans, null if they are more than ``most`` of it, and their characters."""
    at, kept = 0, []
    for a, b in sorted(covered):
        kept.append(text[at : max(at, a)])
        at = max(at, b)
    left = "".join([*kept, text[at:]])
    removed = len(text) - len(left)
    return (None if removed > most * len(text) else left), removed


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 5, share: float = 0.4, most: float = 0.5) -> DataFrame:
    """Return (``doc_id``, ``text``, ``removed``) of the documents that leak items, as ``leaks`` finds them.

    ``text`` lacks the spans of all leaked items; it is null, and the document to be dropped,
    if they are more than ``most`` of its characters. ``removed`` counts the characters. The scan
    that finds the spans cuts them, so no document is moved (beyond the broadcast bounds only those that leak).
    """
    docs, held, grams, table = _prepared(documents, items, n)
    if table is None:
        return _cut_by_join(docs, _by_join(docs, held, grams, n, share), most)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, n, share)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                covered = [x for _, _, own in scanner.hits(text) for x in own]
                if covered:
                    rows.append((doc, *_cut(text, covered, most)))
            yield _cleaned(rows)

    return docs.mapInArrow(scan, CLEANED)


def _cleaned(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text", "removed"])


def _cut_by_join(documents: DataFrame, found: DataFrame, most: float) -> DataFrame:
    merged = found.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cleaned(
                [(r["doc_id"], *_cut(r["text"], [(x["starts"], x["ends"]) for x in r["spans"]], most)) for r in batch.to_pylist()]
            )

    return documents.join(merged, "doc_id").select("doc_id", "text", "spans").mapInArrow(cut, CLEANED)


def _windows(documents: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """Return (``doc_id``, ``gram``): the distinct n-grams of each document whose bit an item's n-gram sets."""
    bit = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = grams.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = WordHashes(), sent.value
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.unique(shingles(hashes.of(text.as_py()), n))
                at = found & np.uint64(FILTER_BITS - 1)
                found = found[(bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int64)), pa.array(found)], ["doc_id", "gram"])

    return documents.mapInArrow(make, "doc_id long, gram long")


def _by_join(documents: DataFrame, items: DataFrame, grams: DataFrame, n: int, share: float) -> DataFrame:
    """The same result when the items' n-grams are too many to broadcast."""
    windows = _windows(documents, grams, n)
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("size"))
    pairs = (
        windows.join(grams, "gram")
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("hit"))
        .join(sizes, "item_id")
        .filter(F.col("hit") >= share * F.col("size") - 1e-9)
        .join(documents, "doc_id")
        .join(items.withColumnRenamed("text", "item_text"), "item_id")
        .select("doc_id", "item_id", "text", "item_text")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                held = checked(r["text"], wanted_of(r["item_text"], n), n, share)
                if held:
                    rows.append((r["doc_id"], r["item_id"], *held))
            yield _hits(rows)

    return pairs.mapInArrow(verify, HITS)
