"""Hard negatives against brute force: ties, windows, shards, odd rows, exactness of the walk."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank string, id int"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    one = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        if i not in one or (label, q) < one[i]:
            one[i] = (label, q)
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, other) for j, (other, p) in one.items() if j != a and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-t, k) for t, k, other in scored if other != label and low * -s <= -100 * t <= high * -s][:negatives]
            out += [(a, j, n, k, -s, t) for n, (t, k) in enumerate(fit, 1)]
    return collections.Counter(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return collections.Counter(tuple(r) for r in H.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(n, width, seed, step=None, labels=3):
    rnd = random.Random(seed)
    draw = lambda: rnd.gauss(0.3, 1) if step is None else rnd.randrange(-2, 4) * step
    return [(i, [draw() for _ in range(width)], rnd.randrange(labels), "x", 0) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "plane", "copies"])
def test_mined_rows_match_brute_force(spark, kind):
    rows = {"spread": lambda: vectors(700, 12, 1), "ties": lambda: vectors(600, 3, 2, step=1 / 256),
            "plane": lambda: vectors(800, 2, 3), "copies": lambda: vectors(200, 4, 4)}[kind]()
    if kind == "copies":
        rows = [(i, rows[0][1] if i % 3 else v, label, "x", 0) for i, v, label, *_ in rows]
    want = brute(rows)
    assert want and found(spark, rows, shard_rows=150, block_rows=5) == want
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rows = vectors(120, 3, 5)
    rows += [(None, [1.0, 1.0, 1.0], 1, "x", 0), (500, None, 1, "x", 0), (550, [1.0, None, 1.0], 1, "x", 0),
             (600, [float("nan"), 1.0, 1.0], 1, "x", 0), (650, [float("inf"), 1.0, 1.0], 1, "x", 0), (700, [1.0, 1.0, 1.0], None, "x", 0),
             (750, [], 1, "x", 0), (751, [], 1, "x", 0), (752, [], 2, "x", 0), (800, [1.0, 2.0], 0, "x", 0), (801, [1.0, 2.0], 0, "x", 0),
             (802, [0.5, 1.5], 1, "x", 0), (850, [0.0, 0.0, 0.0], 2, "x", 0)]
    rows += rows[:60] + [(3, [9.0, 9.0, 9.0], 0, "x", 0)]
    assert found(spark, rows, shard_rows=40) == brute(rows)
    assert found(spark, rows[:0]) == collections.Counter()
    assert not found(spark, [r for r in rows if r[0] is None or r[0] % 50])


def test_large_components_are_exact_and_saturate(spark):
    rnd = random.Random(6)
    big = [(i, [rnd.uniform(-1, 1) * 2.0**20 for _ in range(4)], i % 2, "x", 0) for i in range(150)]
    assert found(spark, big) == brute(big)
    huge = [(i, [2.0**50 * (1 + i % 3)], i % 2, "x", 0) for i in range(60)]
    assert all(r[4] == 2**63 - 1 for r in found(spark, huge))


def test_search_stops_before_it_met_every_row():
    rows = np.array([[i, -i] for i in range(5000)], dtype=np.int64)
    lists, best = H.SortedLists(rows), H._Best(3)
    asked = []
    plain = lists.scores
    lists.scores = lambda rows, anchors: asked.append(len(rows)) or plain(rows, anchors)
    H._searches(lists, np.arange(5000), np.array([[3, -1]]), [H._Search(lambda: np.ones(5000, bool), [best])])
    assert best.ids.tolist() == [4999, 4998, 4997] and sum(asked) < 200


def test_window_bounds():
    for p in range(-250, 251):
        low, high = H.window(p, 50, 95)
        inside = [n for n in range(-300, 301) if 50 * p <= 100 * n <= 95 * p]
        assert inside == list(range(low, high + 1))
