"""Exact quantiles by narrowing bins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafclock.operators import quantiles, summary
from leafclock.operators.quantiles import quantile_table

PROBS = {"lo": 0.0, "a": 0.001, "q": 0.25, "m": 0.5, "b": 0.9999, "hi": 1.0}


def brute(values):
    v = np.array([x for x in values if x is not None and x == x], float)
    return tuple(float(np.quantile(v, p)) for p in PROBS.values()) if len(v) else (None,) * len(PROBS)


def test_a_million_different_values_of_one_group(spark, monkeypatch):
    n = 1_000_000
    value = F.when(F.col("id") % 97 != 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 50_000.0))
    df = spark.range(n).select(F.lit("hot").alias("g"), value.alias("v"))
    df = df.unionByName(spark.createDataFrame([("hot", None)] * 5 + [("ties", 2.0)] * 30_000 + [("ties", 3.0)] * 10, "g string, v double"))
    got = {r.g: tuple(r[1:]) for r in quantile_table(df, ["g"], "v", PROBS, few=500).collect()}
    hot = np.array(df.where("g = 'hot' AND v IS NOT NULL").toPandas()["v"])
    assert len(set(hot)) > 600_000
    assert got["hot"] == pytest.approx(tuple(np.quantile(hot, list(PROBS.values()))), rel=1e-12)
    assert got["ties"] == (2.0, 2.0, 2.0, 2.0, pytest.approx(brute([2.0] * 30_000 + [3.0] * 10)[4]), 3.0)


def test_few_and_odd_values(spark):
    r = random.Random(1)
    groups = {
        "one": [4.5], "two": [1.0, 2.0], "none": [None, float("nan")], None: [7.0, None, 9.0],
        "wide": [10.0 ** r.uniform(-9, 9) * r.choice((1, -1)) for _ in range(300)],
        "steps": [float(i // 7) for i in range(300)], "tiny": [1.0 + i * 2.0 ** -52 for i in range(200)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    for bins, few in ((64, 50), (1024, 10_000)):
        got = {r.g: tuple(r[1:]) for r in quantile_table(df, ["g"], "v", PROBS, bins=bins, few=few).collect()}
        assert got.keys() == groups.keys()
        for g, values in groups.items():
            assert got[g] == (brute(values) if None in brute(values) else pytest.approx(brute(values), rel=1e-9)), (g, bins)


def test_endless_values_and_no_rows(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in [-inf] * 3 + [1.0, 2.0, 3.0, 4.0] + [inf] * 3], "v double")
    got = quantile_table(df, [], "v", {"a": 0.0, "b": 4 / 9, "c": 1.0}, bins=4, few=2).first()
    assert tuple(got) == (-inf, 2.0, inf)
    empty = df.where("v > 5 AND v < 6")
    assert quantile_table(empty, [], "v", PROBS).count() == 0
    assert tuple(summary.five_numbers(empty, "v").first()) == (None,) * 6


def test_no_task_sees_a_group(spark, monkeypatch):
    """Between the scans and the last ranking only counted bins are exchanged."""
    seen = []
    real = quantiles.staged

    def watch(df, name):
        out = real(df, name)
        if name == "bins":
            seen.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "staged", watch)
    df = spark.range(200_000).select((F.col("id") * 0.37 + 1).alias("v"))
    got = quantile_table(df, [], "v", {"m": 0.5}, bins=100, few=100).first()
    assert got.m == pytest.approx(199_999 / 2 * 0.37 + 1)
    assert seen and max(seen) <= 200


def test_short_groups_agree(spark, rows):
    df = spark.createDataFrame([(i % 3, float(i * i % 17)) for i in range(50)], "k int, v double")
    assert rows(summary.five_numbers(df, "v", ["k"])) == rows(summary.five_numbers(df, "v", ["k"], short=True))
