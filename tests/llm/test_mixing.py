import math
import random

import pytest
from pyspark.sql import functions as F

from leafclock.llm import mixing


def brute_targets(sizes, weights, cap=3.0):
    """Shares the excess again and again, as the contract words it."""
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        left = total - sum(out.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not over:
            out |= {s: left * weights[s] / w for s in open_}
            break
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, copies int")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(1200):
        source = r.choice(["a", "b", "B", "é", None] + ["hot"] * 3 + ["tiny"] * (i < 40))
        n = int(r.lognormvariate(4, 1))
        out.append((i, " ".join(["w"] * n), source, 1, "x", 2))
    out += [(5000, None, "a", 1, "x", 2), (5001, "", "b", 1, "x", 2), (5002, "w " * 20_000, "hot", 1, "x", 2)]
    out += [(6000 + i, "same words here", "hot", 1, "x", 2) for i in range(300)] + [(7000, "twice", "a", 1, "x", 2)] * 2
    return out


def test_targets_rates_and_copies(spark, rows):
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, keep_source=True, block=64).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = brute_targets(size, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.01 * want[s] + 5, (s, n, want[s])
    again = mixing.mix(docs.repartition(7), keep_source=True, block=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_solve_the_dual(spark, rows):
    """Rates are the tilt exp(m * size / mean), capped, and meet the targets before rounding."""
    got = mixing.mix(docs_of(spark, rows), keep_source=True, repairs=0).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for s, own in by.items():
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-4)
        tilts = {round(math.log(r.rate) / r.size, 7) for r in own if r.size and 1e-9 < r.rate < 2.999999}
        assert len(tilts) <= 1 or max(tilts) - min(tilts) < 1e-5


def test_empty_and_wordless(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    got = mixing.mix(docs_of(spark, [(1, None, None, 1, "", 1), (2, " ", "a", 1, "", 1)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_mixed_repeats_whole_rows(spark, rows):
    docs = docs_of(spark, rows + [(None, "no id one", "a", 1, "x", 2), (None, "no id two", "a", 1, "x", 2)])
    counted = mixing.mix(docs).agg(F.sum("copies"), F.sum("taken")).first()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == counted[0]
    words = out.select(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert words == counted[1]


def test_given_weights(spark):
    docs = docs_of(spark, [(i, "w " * 10, "ab"[i % 2], 1, "", 1) for i in range(200)])
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    got = mixing.mix(docs, weights, keep_source=True).groupBy("source").agg(F.sum("taken")).collect()
    assert dict(got) == {"a": 500, "b": 1500}
