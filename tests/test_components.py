"""Components: edges contracted inside tasks, and the groups that are not split."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crateflow.operators import components as C
from crateflow.operators import graph as G
from crateflow.plans import graph_plans as P


def _reach(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def test_a_task_sends_a_forest_of_its_edges(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 50)
    rng = np.random.default_rng(3)
    for n in (5, 40, 400):
        u, v = rng.integers(0, n, 300), rng.integers(0, n, 300)
        u, v = np.maximum(u, v)[u != v], np.minimum(u, v)[u != v]
        batches = [pa.record_batch([pa.array(u[i:i + 20]), pa.array(v[i:i + 20])], names=["u", "v"]) for i in range(0, len(u), 20)]
        left = [(a, b) for batch in C._contracted(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
        assert _reach(left) == _reach(zip(u.tolist(), v.tolist()))
        assert n > 40 or len(left) < n
    assert list(C._contracted(iter([])))[0].num_rows == 0


def test_rounds_see_few_edges(spark, monkeypatch):
    seen, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: seen.append((out := cut(df)).count()) or out)
    edges = spark.range(4000, numPartitions=2).select((F.col("id") % 20).alias("u"), ((F.col("id") * 7) % 19).alias("v"))
    assert {r.component for r in C.connected(edges).collect()} == {0}
    assert seen[0] <= 38


def test_memberships_are_dealt_once(spark):
    ids = spark.range(5)
    hubs = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 3), (2, 9), (3, 4), (3, 4), (None, 1)], "hub bigint, id bigint")
    _, h = G._restrict(ids, spark.createDataFrame([], "src bigint, dst bigint"), hubs)
    assert sorted(map(tuple, h.collect())) == [(1, 0), (1, 2)]


def test_small_communities_are_components(spark, monkeypatch):
    v = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (6, 1), (7, 0)], "id bigint, in_collection int")
    pairs = [(1, 2), (2, 3), (4, 5), (5, 6)]
    e = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint")
    monkeypatch.setattr(P, "_rel", lambda m: G.Graph(v, e, spark.createDataFrame([], "hub bigint, id bigint")))
    assert {tuple(r) for r in P.g13(None).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7)}
