"""Language-model scores: chunks, native n-gram and logit scorers, and pluggable batched ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKENIZERS
from tessera.schema import SCORE


@dataclass
class EvaluationConfig:
    """How to score a corpus with a model."""

    model_name_or_path: str
    data_path: str
    model_type: str = "uniform"
    tokenizer_name: str | None = None
    model_args: dict = field(default_factory=dict)
    tokenizer_args: dict = field(default_factory=dict)
    requirements: list[str] = field(default_factory=list)
    add_bos: bool = False
    chunk_size: int = 1024
    batch_size: int = 1

    def __post_init__(self) -> None:
        """Fill in the tokenizer and refuse sizes that make no sense."""
        self.tokenizer_name = self.tokenizer_name or self.model_name_or_path
        if self.chunk_size < 1 or self.batch_size < 1:
            raise ValueError("chunk_size and batch_size must be positive")


def tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = "word") -> DataFrame:
    """Return a row for each token: ``keep``, ``pos`` from 0 and ``tok``."""
    return df.select(*keep, F.posexplode(TOKENIZERS[tokenizer](F.col(text))).alias("pos", "tok"))


def chunk_id(pos: Column, size: int, bos: int = 0) -> Column:
    """Return the chunk of a position; ``bos`` tokens of each chunk are taken by its prefix."""
    return F.floor(pos / F.lit(size - bos)).cast("long")


def chunk_counts(df: DataFrame, key: str, n_tokens: Column, size: int, bos: int = 0) -> DataFrame:
    """Return tokens, chunks and scored tokens of each sample; the first of a chunk has no score.

    Counted from lengths alone: no token is exploded.
    """
    step = size - bos
    chunks = F.ceil(n_tokens / F.lit(step)).cast("long")
    return df.select(
        key, n_tokens.cast("long").alias("tokens"), chunks.alias("chunks"), (n_tokens - chunks).cast("long").alias("scored")
    )


def log_softmax_nll(logits: Column, target: Column) -> Column:
    """Return the negative log probability, in nats, of the ``target``-th (from 0) of the logits.

    The maximum is taken out first, so large logits do not overflow.
    """
    high = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - high.cast("double")))
    return F.log(total) + high.cast("double") - F.get(logits, target).cast("double")


def shifted_nll(df: DataFrame, key: str, pos: str, logits: str, target: str, size: int, bos: int = 0) -> DataFrame:
    """Sum over each sample the scores of its tokens by the logits of the position before.

    A chunk's first token has no position before it and no score; neither have the ``bos``
    tokens in front of a chunk, whose positions are not among ``pos``.
    """
    chunk = chunk_id(F.col(pos), size, bos)
    previous = F.lag(logits).over(Window.partitionBy(key, chunk).orderBy(pos))
    scored = df.withColumn("_nll", log_softmax_nll(previous, F.col(target)))
    return scored.groupBy(key).agg(F.coalesce(F.sum("_nll"), F.lit(0.0)).alias("nll"), F.count("*").alias("tokens"))


def unigram_scores(df: DataFrame, text: str, corpus: str, size: int = 1024, tokenizer: str = "word") -> DataFrame:
    """Score each corpus with its own unigram model: -ln(count / all), first of a chunk left out.

    Types are told apart by 64-bit hashes and counted before they are scored, so the shuffle
    carries numbers, one row for each type of a task, and no tokens. The total of a corpus enters as
    one logarithm, so no window gathers the types of a corpus.
    """
    chunk_start = F.col("pos") % F.lit(size) == 0
    typed = tokens(df, text, [corpus], tokenizer).groupBy(corpus, F.xxhash64("tok").alias("tok")).agg(
        F.count("*").alias("n"), F.sum((~chunk_start).cast("long")).alias("scored")
    )
    counted = typed.withColumns({"_own": F.col("scored") * F.log(F.col("n"))})
    return counted.groupBy(corpus).agg(
        (F.sum("scored") * F.log(F.sum("n")) - F.sum("_own")).alias("nll"), F.sum("n").alias("tokens"), F.sum("scored").alias("scored")
    )


def bigram_types(df: DataFrame, text: str, by: list[str], size: int, bos: int = 0, tokenizer: str = "word") -> DataFrame:
    """Count (``prev``, ``tok``) pairs, as 64-bit hashes, within chunks and by ``by``.

    With ``bos``, a chunk's first token follows the start mark, whose hash is that of "".
    """
    held = df.select(*by, TOKENIZERS[tokenizer](F.col(text)).alias("_t"))
    before = F.concat(F.array(F.lit("")), "_t")
    pairs = held.select(*by, F.posexplode(F.arrays_zip("_t", before.alias("_p"))).alias("pos", "_z")).select(
        *by, "pos", F.col("_z._t").alias("tok"), F.col("_z._p").alias("prev")
    ).filter("tok is not null")
    starts = F.col("pos") % F.lit(size - bos) == 0
    if bos:
        pairs = pairs.withColumn("prev", F.when(starts, "").otherwise(F.col("prev")))
    else:
        pairs = pairs.filter(~starts)
    return pairs.groupBy(*by, F.xxhash64("prev").alias("prev"), F.xxhash64("tok").alias("tok")).agg(F.count("*").alias("n"))


def bigram_scores(df: DataFrame, text: str, by: str, size: int = 1024, bos: int = 0, tokenizer: str = "word") -> DataFrame:
    """Score each corpus with a bigram model of all corpora: -ln(pair / first), per token within chunks.

    One pass counts pairs by corpus. A pair's count and a first word's count are then each found by a
    partial aggregation that keeps the counts of the corpora beside their sum (as many as there are
    corpora, not rows), and the two logarithms are summed by corpus apart: no join, no window,
    and a hot first word is folded before it is shuffled.
    """
    types = bigram_types(df, text, [by], size, bos, tokenizer)

    def logs(counts: DataFrame, *key: str) -> DataFrame:
        """Sum the count of each corpus times the logarithm of the count of all."""
        held = counts.groupBy(*key).agg(F.sum("n").alias("all"), F.collect_list(F.struct(F.col(by), F.col("n"))).alias("_own"))
        parts = held.select("all", F.explode("_own").alias("_o"))
        return parts.groupBy(F.col(f"_o.{by}").alias(by)).agg(F.sum(F.col("_o.n") * F.log("all")).alias("log"), F.sum("_o.n").alias("n"))

    pairs = logs(types, "prev", "tok").select(by, (-F.col("log")).alias("log"), "n")
    firsts = logs(types.groupBy(by, "prev").agg(F.sum("n").alias("n")), "prev").select(by, "log", F.lit(0).cast("long").alias("n"))
    return pairs.unionByName(firsts).groupBy(by).agg(F.sum("log").alias("nll"), F.sum("n").alias("scored"))


def run_log(scores: DataFrame, *by: str) -> DataFrame:
    """Average sample scores into the figures of a run log.

    The compression rate is a ratio of means. No samples give null figures and a count of 0.
    """
    return scores.groupBy(*by).agg(
        F.avg("nll").alias("neg_log_prob_sum"),
        F.avg("tokens").alias("avg tokens"),
        F.avg("chars").alias("avg character count"),
        F.avg("bytes").alias("avg bytes"),
        F.count("*").alias("sample_count"),
    ).withColumn("compression_rate", compression_rate(F.col("neg_log_prob_sum"), F.col("`avg bytes`")))


def compression_rate(nll: Column, size: Column) -> Column:
    """Return the compressed size in percent of the size in bytes."""
    return F.try_divide(nll, size) * F.lit(1 / math.log(2)) * F.lit(0.125) * F.lit(100)


def bits_per(nll: Column, size: Column) -> Column:
    """Return bits per character or byte."""
    return F.try_divide(nll, size) * F.lit(1 / math.log(2))


class Scorer(Protocol):
    """A language model: its tokens, and next-token logits for a padded batch of chunks."""

    parameters: float
    vocabulary: int
    bos: list[int]
    pad: int | None
    eos: int | None

    def encode(self, text: str) -> list[int]:
        """Return the ids of a text."""

    def logits(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Return logits (batch, length, vocabulary)."""


class UniformBytes:
    """Every byte is as likely as any other; arguments are taken and change nothing."""

    parameters, vocabulary, bos, pad, eos = 0.0, 256, [256], 256, None

    def __init__(self, **_: object) -> None:
        """Need nothing."""

    def encode(self, text: str) -> list[int]:
        """Return the UTF-8 bytes."""
        return list(text.encode("utf-8"))

    def logits(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Return equal logits."""
        return np.zeros((*ids.shape, self.vocabulary + 1), np.float32)[..., :256]


class RepeatBytes(UniformBytes):
    """A byte is likely to be followed by itself or a space."""

    parameters = 2e-9

    def __init__(self, space: float = 3.0, same: float = 1.0) -> None:
        """Take the logits of a space and of the last byte."""
        self.space, self.same = space, same

    def logits(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Return logits that favour the last byte and a space."""
        out = np.zeros((*ids.shape, 256), np.float32)
        out[..., 32] = self.space
        rows, places = np.nonzero(ids < 256)
        out[rows, places, ids[rows, places]] += self.same
        return out


SCORERS: dict[str, Callable[..., Scorer]] = {"uniform": UniformBytes, "repeat": RepeatBytes}


def scorer(kind: str, model_args: dict | None = None, tokenizer_args: dict | None = None) -> Scorer:
    """Return a scorer by name, made with the given arguments; an unknown name is an error."""
    if kind not in SCORERS:
        raise NotImplementedError(f"unknown model type: {kind}")
    return SCORERS[kind](**(model_args or {}), **(tokenizer_args or {}))


def pad_id(model: Scorer) -> int:
    """Return the id to pad with: the pad id, else the end id; neither is an error."""
    found = model.pad if model.pad is not None else model.eos
    if found is None:
        raise ValueError("the tokenizer has neither a pad nor an end token")
    return found


def score_batches(texts: list[str], model: Scorer, size: int, add_bos: bool, batch_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the sum of -ln p and the number of tokens of each text.

    Chunks of all texts are sorted by length, longest first, padded on the left and scored in
    batches. What counts is told by lengths and not by comparing ids with the padding.
    """
    bos = model.bos if add_bos else []
    step = size - len(bos)
    chunks: list[tuple[int, list[int]]] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        ids = model.encode(text)
        counts[i] = len(ids)
        chunks += [(i, bos + ids[a : a + step]) for a in range(0, len(ids), step)]
    chunks.sort(key=lambda c: -len(c[1]))
    nll = np.zeros(len(texts))
    for start in range(0, len(chunks), batch_size):
        batch = chunks[start : start + batch_size]
        width = max(len(ids) for _, ids in batch)
        padded = np.full((len(batch), width), pad_id(model), np.int64)
        mask = np.zeros((len(batch), width), bool)
        for row, (_, ids) in enumerate(batch):
            padded[row, width - len(ids) :] = ids
            mask[row, width - len(ids) :] = True
        out = model.logits(padded, mask)
        for row, (i, ids) in enumerate(batch):
            own = out[row, width - len(ids) :][len(bos) :]
            real = np.array(ids[len(bos) :])
            if len(real) > 1:
                given = own[:-1]
                high = given.max(axis=1, keepdims=True)
                total = np.log(np.exp(given - high).sum(axis=1, dtype=np.float64)) + high[:, 0]
                nll[i] += float((total - given[np.arange(len(real) - 1), real[1:]]).sum())
    return nll, counts


def score(df: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Score (``dataset``, ``idx``, ``text``) with a scorer, in Arrow batches within partitions.

    The model is made once in each Python worker and samples never leave their partition. Null
    texts are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer(config.model_type, config.model_args, config.tokenizer_args)
        for pdf in batches:
            texts = pdf["text"].tolist()
            nll, counts = score_batches(texts, model, config.chunk_size, config.add_bos, config.batch_size)
            yield pd.DataFrame(
                {
                    "model": config.model_name_or_path,
                    "dataset": pdf["dataset"],
                    "idx": pdf["idx"],
                    "nll": nll,
                    "tokens": counts,
                    "chars": [len(t) for t in texts],
                    "bytes": [len(t.encode("utf-8")) for t in texts],
                }
            )

    kept = df.select("dataset", F.col("idx").cast("long").alias("idx"), "text").filter("text is not null")
    return kept.mapInPandas(run, SCORE)


def evaluate(df: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Score a corpus and return its run logs, one for each data set, with the configuration."""
    from tessera.sources.sinks import as_map

    found = run_log(score(df, config), "dataset")
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in as_map(d).items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    return found.select(
        "neg_log_prob_sum",
        "`avg tokens`",
        "`avg character count`",
        F.lit(scorer(config.model_type, config.model_args, config.tokenizer_args).parameters).alias("parameters count"),
        "`avg bytes`",
        "sample_count",
        F.lit(config.model_name_or_path).alias("model_name_or_path"),
        F.lit(config.tokenizer_name).alias("tokenizer_name"),
        F.col("dataset").alias("data_path"),
        F.lit(config.chunk_size).cast("long").alias("chunk_size"),
        F.lit(config.add_bos).alias("add_bos"),
        pairs(config.model_args).alias("model_args"),
        pairs(config.tokenizer_args).alias("tokenizer_args"),
        F.array(*map(F.lit, config.requirements)).cast("array<string>").alias("requirements"),
        F.lit(config.batch_size).cast("long").alias("batch_size"),
        "compression_rate",
    )


def with_retries(run: Callable[[], None], attempts: int = 3, pause: float = 10, sleep: Callable[[float], None] | None = None) -> tuple[str, int, str]:
    """Run until it succeeds; return (status, attempts, last error)."""
    import time

    error = ""
    for attempt in range(1, attempts + 1):
        try:
            run()
            return "succeeded", attempt, ""
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                (sleep or time.sleep)(pause)
    return "failed", attempts, error
