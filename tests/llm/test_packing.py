"""Problem 6: every token in one place, nothing over the capacity, little space left."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.packing import TOKENIZER, Plan, fill, packed, token_counts


def check(spark, sizes, capacities, per_step=4):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "id long, n_tokens long, capacity string")
    rows = packed(df, capacities, per_step).collect()
    for w, c in capacities.items():
        own = [r for r in rows if r["window_id"] == w]
        used, steps = defaultdict(list), {}
        pieces = defaultdict(list)
        for r in own:
            pieces[r["id"]].append((r["from_token"], r["n_tokens"]))
            if r["window_no"] is None:
                assert r["n_tokens"] == 0
                continue
            used[r["window_no"]].append((r["offset"], r["offset"] + r["n_tokens"]))
            assert steps.setdefault(r["window_no"], r["step_no"]) == r["step_no"]
        for spans in used.values():
            spans.sort()
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
            assert spans[0][0] >= 0 and spans[-1][1] <= c
        for i, n in enumerate(sizes):
            parts = sorted(pieces[i])
            assert sum(k for _, k in parts) == (n or 0)
            assert len(parts) == max(1, -(-(n or 0) // c))
            assert all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
        if used:
            assert sorted(used) == list(range(len(used)))
            load = defaultdict(int)
            for no, spans in used.items():
                load[steps[no]] += 1
            assert max(load.values()) <= per_step + 1
    return rows


def test_places(spark):
    r = random.Random(1)
    sizes = [int(r.paretovariate(0.8) * 20) % 900 for _ in range(1500)] + [0, None, 64, 65, 128, 129, 4000, 1, 1]
    check(spark, sizes, {1: 64, 2: 128, 3: 512})


def test_ties_and_bounds(spark):
    rows = check(spark, [50] * 1000, {7: 100})
    assert len({r["window_no"] for r in rows}) == 500
    rows = check(spark, [51] * 100 + [49] * 100, {7: 100})
    assert len({r["window_no"] for r in rows}) == 100
    assert packed(spark.createDataFrame([], "id long, n_tokens long"), {1: 8}).count() == 0
    assert packed(spark.createDataFrame([(1, 3)], "id long, n_tokens long"), {}).count() == 0
    with pytest.raises(ValueError):
        packed(spark.createDataFrame([(1, 3)], "id long, n_tokens long"), {1: 0})


def test_fill(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.randint(1, 400)) for i in range(3000)], "id long, n_tokens long")
    row = fill(packed(df, {1: 512})).first()
    assert row["filled"] > 0.97
    assert row["token_spread"] < 0.05 and row["cost_spread"] < 0.05


def windows_of(plan):
    """The lengths in each window of a plan of few items."""
    out = defaultdict(list)
    count = dict(plan.done)
    for length, n in count.items():
        for w in plan.find(np.full(n, length), np.arange(n))[0]:
            out[int(w)].append(length)
    return out


def test_tiers_change_the_plan_and_keep_it_full():
    r = random.Random(6)
    lengths = [min(4096, int(r.lognormvariate(5.5, 1.3)) + 1) for _ in range(6000)]
    sizes = Counter(lengths)
    tiered, flat = (Plan(dict(sizes), 4096, tiers, 8) for tiers in ([512, 1024, 2048, 4096], []))
    a, b = windows_of(tiered), windows_of(flat)
    assert sorted(map(sorted, a.values())) != sorted(map(sorted, b.values()))
    for found in (a, b):
        assert sorted(x for own in found.values() for x in own) == sorted(lengths)
        assert max(map(sum, found.values())) <= 4096
    assert tiered.windows <= 1.005 * flat.windows


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    plan = Plan({700: 2, 300: 2, 200: 4}, 1000, [250, 500], 8)
    assert sorted(map(sorted, windows_of(plan).values())) == [[200] * 4, [300, 700], [300, 700]]


def test_steps_cost_alike():
    r = random.Random(8)
    sizes = Counter(r.choice([40, 60, 900, 1000]) for _ in range(4000))
    plan = Plan(dict(sizes), 1000, [100], 4)
    cost, step = defaultdict(int), {}
    for length, n in plan.done.items():
        for w, _, s in zip(*plan.find(np.full(n, length), np.arange(n))):
            cost[int(w)] += length**2
            step[int(w)] = int(s)
    total = Counter()
    for w, c in cost.items():
        total[step[w]] += c
    values = np.array(list(total.values()))
    spread = values.std() / values.mean()
    assert spread < 0.05
    in_order = np.array([cost[w] for w in sorted(cost)])[: len(cost) // 4 * 4].reshape(-1, 4).sum(axis=1)
    assert in_order.std() / in_order.mean() > 2 * spread


def test_plan_is_small():
    plan = Plan({n: 10**9 + n for n in range(1, 4097)}, 4096, [512, 1024, 2048, 4096], 8)
    assert len(plan.steps) < 4 * 4096
    assert plan.windows * 4096 >= sum(n * (10**9 + n) for n in range(1, 4097))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a" * 100_000)], "id long, t string")
    got = {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "t").collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0)
    assert got[4] > 1000
