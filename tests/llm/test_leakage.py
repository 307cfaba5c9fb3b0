"""Problem 7 against brute force."""

import random

from tessera.llm import leakage
from tessera.llm.leakage import leaks, without_leaks
from tests.llm import brute


def data(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [" ".join(r.choices(vocab, k=30)) for _ in range(8)] + [None, "", "a b c", "x y z u v"]
    items.append(items[0])
    docs = []
    for i in range(40):
        text = " ".join(r.choices(vocab, k=60))
        if i % 2:
            w = items[i % 8].split()
            text += ". " + ", ".join(w[: r.randint(5, 30)]).upper() + "! " + " ".join(r.choices(vocab, k=5))
        docs.append(text)
    docs += [None, "", "X y. Z u v", "x " * 50_000 + "y z u v"]
    d = spark.createDataFrame([(i, t, "o") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    q = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(docs):
        for j, u in enumerate(items):
            g = brute.grams(u, 5)
            if g and len(g & brute.grams(t, 5)) >= 0.4 * len(g):
                want.add((i, j))
    return d, q, want


def test_like_brute_force(spark, monkeypatch):
    docs, items, want = data(spark)
    got = leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    monkeypatch.setattr(leakage, "BROADCAST_GRAMS", 3)
    joined = leaks(docs, items)
    assert sorted(map(str, joined.collect())) == sorted(map(str, got.collect()))


def test_removal(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "Before it. One two, three FOUR five six! After all of this."), (2, "one two three four five six"), (3, "none")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(9, "one two three four five six")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in without_leaks(docs, items).collect()}
    assert got == {1: ("Before it. ! After all of this.", 28), 2: (None, 27)}
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 3)
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in without_leaks(docs, items).collect()} == got
    assert leaks(docs, items.limit(0)).count() == 0
    assert leaks(docs.limit(0), items).count() == 0
