"""Scorers against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import scoring as S

TEXTS = ["a b a b a c", "", "a", "b b b c a b a a c", " x  y z "]


def bigram(texts, size, bos):
    step, pairs, per = size - bos, Counter(), []
    for t in texts:
        w, own = t.split(), []
        for i, tok in enumerate(w):
            prev = w[i - 1] if i % step else ("" if bos else None)
            if prev is not None:
                own.append((prev, tok))
        pairs.update(own)
        per += own
    first = Counter()
    for (p, _), n in pairs.items():
        first[p] += n
    return sum(-math.log(pairs[x] / first[x[0]]) for x in per), len(per)


@pytest.mark.parametrize(("size", "bos"), [(3, 0), (4, 1), (100, 0), (2, 1)])
def test_bigram(spark, size, bos):
    df = spark.createDataFrame([("s", t) for t in TEXTS] + [("s", None)], "g string, t string")
    row = S.bigram_scores(df, "t", "g", size, bos).first()
    nll, n = bigram(TEXTS, size, bos)
    assert row["scored"] == n
    assert row["nll"] == pytest.approx(nll)


def test_unigram_and_chunks(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(TEXTS)], "g string, i int, t string")
    all_words = Counter(w for t in TEXTS for w in t.split())
    total = sum(all_words.values())
    nll = sum(-math.log(all_words[w] / total) for t in TEXTS for i, w in enumerate(t.split()) if i % 4)
    row = S.unigram_scores(df, "t", "g", 4).first()
    assert (row["tokens"], row["nll"]) == (total, pytest.approx(nll))
    counts = S.chunk_counts(spark.range(0, 9), "id", F.col("id"), 4).orderBy("id").collect()
    assert [(r["chunks"], r["scored"]) for r in counts] == [(math.ceil(n / 4), n - math.ceil(n / 4)) for n in range(9)]
    assert sum(r["scored"] for r in counts) == sum(r["tokens"] for r in counts) - sum(r["chunks"] for r in counts)


def test_log_softmax_is_stable(spark):
    df = spark.createDataFrame([([1e4, 1e4 - 1, 0.0], 1), ([0.0], 0)], "l array<double>, t int")
    got = [r[0] for r in df.select(S.log_softmax_nll(F.col("l"), F.col("t"))).collect()]
    assert got == [pytest.approx(1 + math.log(1 + math.exp(-1))), pytest.approx(0)]


class Plain(S.RepeatBytes):
    """The same model, scored one chunk at a time."""


@pytest.mark.parametrize("bos", [False, True])
@pytest.mark.parametrize("batch", [1, 3, 50])
def test_batches_do_not_change_scores(bos, batch):
    texts = ["hello world", "", "a", "xxxxxxxxxx yyy", "é😀", "b" * 40]
    model = Plain()
    want = []
    for t in texts:
        ids, total = model.encode(t), 0.0
        pre = model.bos if bos else []
        step = 8 - len(pre)
        for a in range(0, len(ids), step):
            part = pre + ids[a : a + step]
            out = model.logits(np.array([part]), np.ones((1, len(part)), bool))[0].astype(float)
            for i in range(len(pre) + 1, len(part)):
                row = out[i - 1]
                total += math.log(np.exp(row - row.max()).sum()) + row.max() - row[part[i]]
        want.append(total)
    nll, counts = S.score_batches(texts, model, 8, bos, batch)
    assert nll == pytest.approx(np.array(want), rel=1e-5)
    assert counts.tolist() == [len(t.encode()) for t in texts]


def test_evaluate(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["abc", "é" * 5, None])], "dataset string, idx int, text string")
    row = S.evaluate(df, S.EvaluationConfig("m", "d", "uniform", model_args={"a": 1}, chunk_size=4)).first()
    assert row["sample_count"] == 2
    assert row["model_args"] == {"a": "1"}
    assert row["neg_log_prob_sum"] == pytest.approx((2 + 7) / 2 * math.log(256))
    bpb = row["neg_log_prob_sum"] / row["avg bytes"] / math.log(2)
    assert row["compression_rate"] == pytest.approx(bpb * 12.5)
    assert S.evaluate(df.limit(0), S.EvaluationConfig("m", "d")).count() == 0
    plain, flat = (S.EvaluationConfig("m", "d", "repeat", model_args=x) for x in ({}, {"space": 0.0, "same": 0.0}))
    assert S.evaluate(df, flat).first()["neg_log_prob_sum"] == pytest.approx(row["neg_log_prob_sum"], rel=0.5)
    assert S.evaluate(df, plain).first()["neg_log_prob_sum"] != S.evaluate(df, flat).first()["neg_log_prob_sum"]


def test_configuration():
    with pytest.raises(NotImplementedError):
        S.scorer("none")
    with pytest.raises(ValueError):
        S.EvaluationConfig("m", "d", chunk_size=0)
    assert S.EvaluationConfig("m", "d").tokenizer_name == "m"
    nothing = S.UniformBytes()
    nothing.pad = None
    with pytest.raises(ValueError):
        S.pad_id(nothing)
    nothing.eos = 3
    assert S.pad_id(nothing) == 3
    calls = []

    def fail():
        calls.append(1)
        raise KeyError("x")

    assert S.with_retries(fail, 3, 0, lambda _: None)[:2] == ("failed", 3)
    assert S.with_retries(lambda: None)[:2] == ("succeeded", 1)
