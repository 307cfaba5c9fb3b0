"""Problem 5 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import history
from tessera.llm.history import History, chunk, least_shared, step_of
from tessera.llm.words import WordHashes, shingles
from tessera.plans.shared import new_path
from tests.llm import brute


def make(seed, **kw):
    r = random.Random(seed)
    texts = [*brute.family(seed, **kw), None, "", "a b", "a b c"]
    texts += [texts[0], texts[0].upper(), texts[5]]
    turns = sorted(r.choice([0, 0, 1, 2, 3]) for _ in texts)
    return [(i * 3, t, x) for i, (t, x) in enumerate(zip(turns, texts))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, turn int, text string").withColumn("scope", F.lit(0))


def run(spark, rows, by_turn, n=3, threshold=0.7, twice=False):
    df = frame(spark, rows)
    path = new_path(spark, "test-history")
    store = History(spark, path, n, threshold)
    store.start(df.filter("turn = 0"))
    turns = [(t, F.col("turn") == t) for t in (1, 2, 3)] if by_turn else [(1, F.col("turn") > 0)]
    out = {}
    for t, chosen in turns:
        if twice and t == 1:
            store.check(df.filter(chosen), df, t)
            store = History(spark, path, n, threshold)
        out |= {r["id_b"]: r["id_a"] for r in store.check(df.filter(chosen), df, t).collect()}
    return out


@pytest.mark.parametrize("by_turn", [False, True])
def test_like_brute_force(spark, by_turn):
    rows = make(11)
    assert run(spark, rows, by_turn) == brute.rejected(rows, 3, 0.7)


def test_batch_tried_again_in_a_store_opened_again(spark):
    rows = make(12, bases=5)
    assert run(spark, rows, True, twice=True) == brute.rejected(rows, 3, 0.7)


def test_common_chunks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 1)
    monkeypatch.setattr(history, "SPLIT", 3)
    rows = make(5, bases=4)
    assert run(spark, rows, False) == brute.rejected(rows, 3, 0.7)


def edited(words, at):
    return [*words[:at], "edited", *words[at + 1 :]]


def test_edits_outside_a_common_header(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 4)
    r = random.Random(3)
    header = "this work may be used by anyone who keeps this notice".split()
    bodies = [r.choices([f"body{i}" for i in range(2000)], k=30) for _ in range(20)]
    texts = [header + body for body in bodies] + [header + edited(body, 15) for body in bodies]
    rows = [(i, int(i >= 20), " ".join(text)) for i, text in enumerate(texts)]
    assert run(spark, rows, False) == brute.rejected(rows, 3, 0.7) == {20 + i: i for i in range(20)}


def test_short_texts_lose_no_link(spark):
    r = random.Random(7)
    texts = [r.choices([f"word{i}" for i in range(5000)], k=n) for n in (4, 6, 8, 12, 16, 24, 40) for _ in range(30)]
    rows = [(i, int(i >= 210), " ".join(x)) for i, x in enumerate([*texts, *([*x, "end"] for x in texts)])]
    want = brute.rejected(rows, 3, 0.7)
    assert run(spark, rows, False) == want
    assert len(want) >= 150


def test_most_of_the_text_is_common(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 4)
    r = random.Random(9)
    header = [f"notice{i}" for i in range(60)]
    own = [r.choices([f"own{i}" for i in range(2000)], k=20) for _ in range(12)]
    texts = [header + x for x in own] + [header + edited(x, 10) for x in own]
    rows = [(i, int(i >= 12), " ".join(text)) for i, text in enumerate(texts)]
    assert run(spark, rows, False) == brute.rejected(rows, 3, 0.7)


def test_chain_is_decided_in_order(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(i, int(i > 0), " ".join(words[i * 6 : i * 6 + 80])) for i in range(12)]
    want = brute.rejected(rows, 3, 0.7)
    assert 0 < len(want) < 11
    assert run(spark, rows, False) == want


def test_empty(spark):
    rows = [(1, 0, "a b c d e f")]
    assert run(spark, rows, False) == {}
    assert run(spark, [(1, 1, "a b c d"), (2, 1, "a b c d")], False) == {2: 1}


def chunks_of(words, hashes):
    grams = shingles(np.array([hashes[x] for x in words], np.uint64), 3)
    return chunk(grams, np.cumsum([len(x) for x in words]), step_of(len(np.unique(grams))))


def test_edits_change_few_chunks():
    words = [f"w{i}" for i in range(1200)]
    hashes = WordHashes()
    before, sizes, _ = chunks_of(words, hashes)
    after, _, _ = chunks_of([*words[:700], "new", "words", *words[700:]], hashes)
    assert 0.8 * sum(map(len, words)) < sizes.sum() <= sum(map(len, words))
    assert 20 <= len(before) <= 80
    assert len(np.setdiff1d(after, before)) <= 4


@pytest.mark.parametrize("length", [70, 130, 400, 1500])
def test_recall_of_the_candidate_step(length):
    """Random pairs just above the threshold: no chunk count below what is asked for."""
    r = random.Random(length)
    hashes = WordHashes()
    for _ in range(25):
        words = r.choices([f"w{i}" for i in range(3000)], k=length)
        other = list(words)
        while True:
            more = edited(other, r.randrange(length))
            if brute.similarity(" ".join(words), " ".join(more), 3) < 0.7:
                break
            other = more
        (a, _, _), (b, _, cb) = chunks_of(words, hashes), chunks_of(other, hashes)
        na, nb = (len(brute.grams(" ".join(x), 3)) for x in (words, other))
        if step_of(na) > step_of(nb):
            b = b[cb]
        common = 0.7 / 1.7 * (na + nb)
        shared = len(np.intersect1d(a, b))
        assert shared >= (np.ceil(common - 1e-9) if step_of(na) == step_of(nb) == 1 else least_shared(len(b), min(1, common / nb)))


def framed(n, seed=21):
    """Texts of which half is a common notice, and as many later ones of the same kind; the last repeats the first."""
    r = random.Random(seed)
    notice = [f"notice{i}" for i in range(110)]
    texts = [notice + r.choices([f"own{i}" for i in range(9000)], k=100) for _ in range(2 * n)]
    return [(i, int(i >= n), " ".join(x)) for i, x in enumerate([*texts, edited(texts[0], 150)])]


def test_few_jobs_in_a_batch(spark):
    """What a driver keeps of each job adds up over the batches."""
    spark.sparkContext.setJobGroup("few-jobs", "one batch")
    try:
        assert run(spark, framed(20), False) == {40: 0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 60


@pytest.mark.parametrize("windows, chunks", [(20, 20), (47, 47), (60, 31), (300, 26), (300, 9), (5000, 300)])
def test_most_windows_is_where_more_chunks_are_needed(windows, chunks):
    t, exact = 0.7, windows < 48
    for shared in range(1, chunks + 1):
        most = history.most_windows(t, windows, chunks, np.array([shared]), exact)[0]
        for other in range(int(np.ceil(t * windows)), int(windows / t) + 1):
            common = t / (1 + t) * (windows + other)
            place = int(min(15, np.floor((common / windows - t) / (1 - t) * 16 + 1e-9)))
            least = np.ceil(common - 1e-9) if exact else history.needed(t)[place, min(chunks, history.MOST)]
            assert (other <= most) == (least <= shared)
