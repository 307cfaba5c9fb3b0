"""Problem 1 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.links import components
from tessera.llm.near_duplicates import Golay, Sketcher, group_pairs, near_duplicates
from tests.llm import brute


def test_golay_code():
    code = Golay()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    for weight in (1, 2):
        y = x.copy()
        for _ in range(weight):
            y ^= (1 << rng.integers(0, 23, len(x))).astype(np.int32)
        shared = [bool(set(a) & set(b)) for a, b in zip(code.indices(x).tolist(), code.indices(y).tolist())]
        assert all(shared)
    assert {len(set(r)) for r in code.indices(x).tolist()} <= {1, 6}
    assert np.bincount(code.index(np.arange(1 << 23, dtype=np.int32))).tolist() == [2048] * 4096


def test_blocks_do_not_change_sketches():
    grams = np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64)
    anchors, values = Sketcher().least(grams)
    again = [Sketcher().least(part) for part in np.array_split(grams, 7)]
    assert (np.minimum.reduce([v for _, v in again]) == values).all()
    assert set(anchors) <= {a for part, _ in again for a in part}


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.7), (5, 0.8)])
def test_like_brute_force(spark, n, threshold):
    texts = dict(enumerate([*brute.family(3), None, "", "too few", "A  b, C d e f.", "a B c D e F"]))
    rows = [(i, t, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "key long, body string, id string")
    got = {r["id"]: r["group_id"] for r in near_duplicates(df, "key", "body", n, threshold).collect()}
    assert got == brute.groups(texts, n, threshold)


def test_copies_scope_and_pairs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(40)], "id long, text string")
    got = near_duplicates(df, "id", "text", scope=F.pmod("id", F.lit(2)))
    assert {(r["id"], r["group_id"], r["copy_of"]) for r in got.collect()} == {(i, i % 2, i % 2) for i in range(40)}
    assert group_pairs(got).count() == 2 * 190
    assert near_duplicates(df.limit(0), "id", "text").count() == 0
    long = spark.createDataFrame([(i, " ".join(f"x{j}" for j in range(200_000 + i))) for i in range(2)], "id long, text string")
    assert [r["group_id"] for r in near_duplicates(long, "id", "text").collect()] == [0, 0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
