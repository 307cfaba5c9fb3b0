"""Problem 8: the language of documents and paragraphs by error-correcting output codes.

Each language has a code word of 15 bits; any two differ in eight. For every bit a binary
classifier over character trigrams tells the languages with a 1 from those with a 0. It is
fitted on a bounded sample of labelled documents, cleaned once of paragraphs that the first fit
contradicts, and weighted by its accuracy on paragraphs held out. A paragraph gets the language
whose code word costs the least weighted loss; a small lead over the next one marks it ambiguous,
and a paragraph of some length that is far from every code word is in another language ("other").
Segments are runs of sentences of one language within a paragraph, decoded in the same way.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ["ar", "de", "en", "es", "fr", "ja", "zh"]
#: Spellings of each language: codes, and names in English and in the language itself.
SPELLINGS = {
    "ar": ["ar", "ara", "arb", "arabic", "العربية"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français"],
    "ja": ["ja", "jpn", "japanese", "日本語"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "中文", "汉语", "漢語"],
}
#: Labelled documents per language, and characters of each, used to fit.
SAMPLE, SAMPLE_CHARS = 200, 20_000
TABLE, BITS, LETTERS, LEAD, BLOCK = 1 << 15, 15, 4, 0.1, 500_000
#: Loss beyond which a paragraph of at least ``KNOWN`` letters is in none of the languages.
OTHER, KNOWN = 0.4, 40
#: Letters that a segment has at the least; shorter sentences join the one before.
SEGMENT = 40
_SENTENCE = re.compile(r"(?<=[.!?;:»”\")])\s+|(?<=[。！？；؟])")
_LINK = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\S+")


def named_language(label: Column) -> Column:
    """Return the code of the language that a label names, else null; case and region are free."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_(,;-]+)", 1)
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), word)


def code_words() -> np.ndarray:
    """Return seven words of the simplex code of length 15, as -1 and 1; no bit is the same in all."""
    rows = [1, 2, 4, 8, 15, 3, 12]
    parity = np.array([[bin(r & c).count("1") & 1 for c in range(1, BITS + 1)] for r in rows])
    return parity * 2 - 1


CJK = 3  # the symbol of all Chinese characters; 1 and 2 are those of kana


def _symbols() -> np.ndarray:
    """Return a symbol for each code point of the basic plane: 0 for what is not a letter.

    Beyond it only Chinese characters are letters; no other script of these languages lies there.
    """
    table = np.zeros(65536, np.uint32)
    for c in range(65536):
        if unicodedata.category(chr(c))[0] == "L":
            name = unicodedata.name(chr(c), "")
            block = reduce(
                lambda found, kind: found or (kind in name and kind),
                ("HIRAGANA", "KATAKANA", "CJK", "ARABIC", "HANGUL"),
                "",
            )
            table[c] = 1 + ("HIRAGANA", "KATAKANA", "CJK", "ARABIC", "HANGUL").index(block) if block else max(c, 32)
    return table


class Trigrams:
    """Hashed trigrams of the paragraphs of a batch of texts."""

    def __init__(self) -> None:
        self.table = _symbols()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Return trigram indices, the paragraph of each, the number of paragraphs of each text, and letters.

        The last are the letters of each paragraph, of which one of Chinese or Japanese counts twice.

        Paragraphs are counted through all texts. Links, digits and single Latin letters
        (those of formulas) are no part of a language and are left out.
        """
        lowered = [_LINK.sub(" ", t).lower() if "://" in t or "@" in t or "www." in t else t.lower() for t in texts]
        whole = "\n".join(lowered) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        beyond = np.where((codes >= 0x20000) & (codes < 0x40000), CJK, 0)
        symbols = np.where(codes < 65536, self.table[np.minimum(codes, 65535)], beyond)
        symbols = np.concatenate([[0], symbols, [0]]).astype(np.uint32)
        mid = symbols[1:-1]
        lone = (symbols[:-2] == 0) & (symbols[2:] == 0) & (mid > 31)
        symbols[1:-1][lone] = 0
        at = np.flatnonzero(symbols[1:-1])
        hashed = symbols[at] * np.uint32(0x9E3779B1) + symbols[at + 1] * np.uint32(0x85EBCA6B)
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + symbols[at + 2] * np.uint32(0xC2B2AE35)
        hashed = (hashed ^ (hashed >> np.uint32(16))) * np.uint32(0x297A2D39) >> np.uint32(17)
        breaks = np.flatnonzero(codes == 10)
        paragraph = np.searchsorted(breaks, at)
        counts = np.array([t.count("\n") + 1 for t in lowered])
        letters = np.bincount(paragraph, 1.0 + (mid[at] <= CJK), int(counts.sum())).astype(np.int64)
        return hashed.astype(np.int64), paragraph, counts, letters


class Model:
    """The fitted classifiers: a table of weights by trigram and bit, and a weight for each bit."""

    def __init__(self, weights: np.ndarray, trust: np.ndarray) -> None:
        self.weights, self.trust = weights.astype(np.float32), trust

    def scores(self, grams: np.ndarray, paragraph: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Return the mean score of each paragraph for each bit, and its number of letters."""
        letters = np.bincount(paragraph, minlength=n)
        sums = np.zeros((n, BITS), np.float32)
        for at in range(0, len(grams), BLOCK):
            own = paragraph[at : at + BLOCK]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[starts]] += np.add.reduceat(self.weights[grams[at : at + BLOCK]], starts, axis=0)
        return sums / np.maximum(letters, 1)[:, None], letters

    def decode(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return the number of the nearest language, the confidence and the loss of each paragraph."""
        margins = np.clip(scores * 4, -8, 8)[:, None, :] * code_words()[None]
        loss = (np.log1p(np.exp(-margins)) * self.trust).sum(axis=2) / self.trust.sum()
        odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        return loss.argmin(axis=1), odds.max(axis=1), loss.min(axis=1)


def _fit(grams: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(LANGUAGES), TABLE))
    for g, label in zip(grams, labels):
        counts[label] += np.bincount(g, minlength=TABLE)
    rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    rates[counts.sum(axis=1) == 0] = 1 / TABLE
    ones = (code_words() > 0).T.astype(float)
    zeros = 1 - ones
    up = ones @ rates / ones.sum(axis=1, keepdims=True)
    down = zeros @ rates / zeros.sum(axis=1, keepdims=True)
    return np.log(up / down).T


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) rows. Every fifth paragraph is held out to weigh the bits."""
    grams, labels, maker = [], [], Trigrams()
    for text, language in rows:
        found, paragraph, _, _ = maker.of([text])
        for p in np.unique(paragraph):
            own = found[paragraph == p]
            if len(own) >= 20:
                grams.append(own)
                labels.append(LANGUAGES.index(language))
    labels = np.array(labels, np.int64)
    if not len(labels):
        return Model(np.zeros((TABLE, BITS)), np.ones(BITS))
    held = np.arange(len(labels)) % 5 == 4
    weights = _fit([g for g, h in zip(grams, held) if not h], labels[~held])
    score = np.array([weights[g].mean(axis=0) for g in grams])
    agree = Model(weights, np.ones(BITS)).decode(score)[0] == labels
    kept = agree & ~held
    if kept.any():
        weights = _fit([g for g, k in zip(grams, kept) if k], labels[kept])
        score = np.array([weights[g].mean(axis=0) for g in grams])
    test = held & agree
    right = ((score[test] > 0) == (code_words()[labels[test]] > 0)).mean(axis=0) if test.any() else np.full(BITS, 0.5)
    right = np.clip(right, 0.55, 0.999)
    return Model(weights, np.log(right / (1 - right)))


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """Return at most ``per_language`` labelled (text, language) rows of each language, cut at ``SAMPLE_CHARS``.

    Ids are chosen from ids and labels alone, so the texts are read but for those chosen once.
    """
    named = documents.select("doc_id", "text", named_language(F.col("lang")).alias("language")).filter("language is not null")
    order = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = named.select("doc_id", "language").withColumn("rank", F.row_number().over(order))
    chosen = ranked.filter(F.col("rank") <= per_language).select("doc_id", "rank")
    rows = named.join(F.broadcast(chosen), "doc_id").filter("text is not null").select(
        F.substring("text", 1, SAMPLE_CHARS).alias("text"), "language", "rank"
    )
    return [(r["text"], r["language"]) for r in rows.orderBy("language", "rank").collect()]


PARAGRAPHS = "doc_id long, named string, para_no long, lang string, confidence double, ambiguous boolean, letters long"
SEGMENTS = "doc_id long, para_no long, seg_no long, start_pos long, end_pos long, lang string, confidence double"
_CODES = np.array([*LANGUAGES, "other"], object)


def _decoded(maker: Trigrams, model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Return the number of the language, confidence, letters, and whether it has a language, of each line of ``texts``."""
    grams, line, counts, letters = maker.of(texts)
    n = int(counts.sum())
    scores, size = model.scores(grams, line, n)
    best, sure, loss = model.decode(scores)
    return np.where((loss > OTHER) & (size >= KNOWN), len(LANGUAGES), best), sure, size, letters >= LETTERS, counts


def paragraphs(documents: DataFrame, model: Model) -> DataFrame:
    """Return (``doc_id``, ``named``, ``para_no``, ``lang``, ``confidence``, ``ambiguous``, ``letters``).

    One row for each paragraph (split at line feeds, counted from 1 with the empty ones) that
    has at least ``LETTERS`` letters of running text, where Chinese and Japanese ones count twice. ``named``
    is the language that the document's label names, or null. ``lang`` is "other" for a paragraph
    that is far from every language. Null and empty texts give no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, model = Trigrams(), sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                part = whole.slice(start, 128)
                best, sure, size, kept, counts = _decoded(maker, model, part.column(2).to_pylist())
                number = np.arange(len(best)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                owner = pa.array(np.repeat(np.arange(part.num_rows), counts)[kept])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(owner),
                        part.column(1).take(owner),
                        pa.array(number[kept]),
                        pa.array(_CODES[best[kept]], pa.string()),
                        pa.array(np.round(sure[kept].astype(np.float64), 4)),
                        pa.array((sure[kept] < 0.5 + LEAD) | (best[kept] == len(LANGUAGES))),
                        pa.array(size[kept]),
                    ],
                    [part.split()[0] for part in PARAGRAPHS.split(", ")],
                )

    return (
        documents.select(F.col("doc_id").cast("long"), named_language(F.col("lang")).alias("named"), "text")
        .filter("text is not null")
        .mapInArrow(label, PARAGRAPHS)
    )


def sentences(paragraph: str) -> list[tuple[int, int]]:
    """Return the sentences of a paragraph as (start, end), those of few letters joined to the one before."""
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(paragraph)), len(paragraph)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        size = sum(2 if c > "\u2fff" else 1 for c in paragraph[a:b] if c.isalpha())
        if out and (size < SEGMENT or out[-1][2] < SEGMENT):
            out[-1] = (out[-1][0], b, out[-1][2] + size)
        elif a < b:
            out.append((a, b, size))
    return [(a, b) for a, b, _ in out]


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """Return the segments of the paragraphs that mix languages.

    A segment is a run of sentences of one language; positions count the characters of the text from
    1, both inclusive. Paragraphs of one language have no rows; null and empty texts neither.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, model = Trigrams(), sent.value
        for batch in batches:
            places, lines = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for number, paragraph in enumerate(text.split("\n"), 1):
                    found = sentences(paragraph)
                    if len(found) > 1:
                        places += [(doc, number, at + a, at + b) for a, b in found]
                        lines += [paragraph[a:b] for a, b in found]
                    at += len(paragraph) + 1
            rows: list[tuple] = []
            if lines:
                best, sure, size, kept, _ = _decoded(maker, model, lines)
                for (doc, number, a, b), lang, p, n in zip(np.array(places)[kept].tolist(), best[kept], sure[kept], size[kept]):
                    last = rows[-1] if rows else None
                    if last and last[:2] == [doc, number] and last[4] == lang:
                        rows[-1] = [doc, number, last[2], b, lang, last[5] + p * n, last[6] + n]
                    else:
                        rows.append([doc, number, a, b, lang, p * n, n])
            runs: dict[tuple, int] = Counter((r[0], r[1]) for r in rows)
            seen: dict[tuple, int] = Counter()
            out = []
            for doc, number, a, b, lang, total, n in rows:
                if runs[doc, number] > 1:
                    seen[doc, number] += 1
                    out.append((doc, number, seen[doc, number], a + 1, b, _CODES[lang], round(float(total / n), 4)))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], [x.split()[0] for x in SEGMENTS.split(", ")]
            )

    return documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null").mapInArrow(label, SEGMENTS)


def documents_by_language(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Return the language of each document of ``documents`` from its paragraphs ``rows``.

    ``lang`` has the most letters (ties: first by code), ``confidence`` is the mean confidence
    of its paragraphs times its share of the letters, ``mixed`` tells whether another language
    has a tenth of them or more, ``ambiguous`` whether half of them or more are in ambiguous paragraphs.
    All four are null for a document without a paragraph of running text.
    """
    by = rows.groupBy("doc_id", "lang").agg(
        F.sum("letters").alias("n"),
        F.sum(F.col("letters") * F.col("confidence")).alias("sure"),
        F.sum(F.when(F.col("ambiguous"), F.col("letters")).otherwise(0)).alias("unsure"),
    )
    best = by.groupBy("doc_id").agg(
        F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"),
        F.max("n").alias("most"),
        F.sum("n").alias("all"),
        F.sum("unsure").alias("unsure"),
        F.min_by("sure", F.struct(-F.col("n"), "lang")).alias("sure"),
    )
    return documents.select(F.col("doc_id").cast("long")).join(best, "doc_id", "left").select(
        "doc_id",
        "lang",
        F.round(F.col("sure") / F.col("all"), 4).alias("confidence"),
        (F.col("most") <= 0.9 * F.col("all")).alias("mixed"),
        (2 * F.col("unsure") >= F.col("all")).alias("ambiguous"),
    )
