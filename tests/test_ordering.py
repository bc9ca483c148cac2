"""Distributed positions, top-k and exact medians."""

import random

from pyspark.sql import functions as F

from crateflow.operators.load import exact_median_by
from crateflow.operators.ordering import top_k, with_position


def test_with_position_consecutive(spark):
    data = [(i, random.Random(i).randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v long").repartition(7)
    out = with_position(df, [F.col("v"), F.col("id")]).collect()
    expect = sorted(data, key=lambda r: (r[1], r[0]))
    assert [(r.id, r.v) for r in sorted(out, key=lambda r: r.pos)] == expect
    assert sorted(r.pos for r in out) == list(range(1, 501))


def test_top_k(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id long")
    out = top_k(df, [F.col("id").desc()], 3).collect()
    assert [(r.id, r.pos) for r in out] == [(99, 1), (98, 2), (97, 3)]


def test_exact_median_matches_python(spark):
    rng = random.Random(7)
    rows = [(k, float(rng.randint(0, 100))) for k in range(5) for _ in range(rng.randint(1, 30))]
    rows += [(99, float(x)) for x in range(1000)]  # a hot key spanning several partitions
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    got = {r.k: r.median for r in exact_median_by(df, "k", "v").collect()}
    import statistics
    for k in {r[0] for r in rows}:
        assert abs(got[k] - statistics.median([v for kk, v in rows if kk == k])) < 1e-9
