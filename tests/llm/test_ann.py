import math

import numpy as np
import pytest

from leafclock.llm import ann

EVERY = "vec_id % 10 = 0"


def brute(rows, k=10):
    valid = [(i, np.array(v, float)) for i, v in rows
             if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, v in valid:
        if q % 10 == 0:
            d = {}
            for i, w in valid:
                if i != q and len(w) == len(v):
                    d[i] = min(d.get(i, math.inf), float(np.sqrt(((w - v) ** 2).sum())))
            out[q] = sorted((s, i) for i, s in d.items())[:k]
    return out


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 0.5, 3) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, score double, rank int")


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(4)
    centres = g.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.3 * g.normal(size=24)).tolist()) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(40)]  # copies tie
    return rows


def test_recall_and_exact_scores(spark, rows):
    df = frame(spark, rows)
    got, want = collected(ann.search(df, EVERY)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    points = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        assert np.allclose([s for s, _ in found], [np.sqrt(((points[i] - points[q]) ** 2).sum()) for _, i in found], atol=1e-12)
    assert ann.recall(df, EVERY) == pytest.approx(hits / sum(map(len, want.values())))


def test_small_blocks_change_nothing(spark, rows):
    df = frame(spark, rows)
    assert collected(ann.search(df, EVERY, block=16)) == collected(ann.search(df, EVERY))


def test_few_and_odd_vectors_are_searched_in_full(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, -3.0]), (2, [1e200, 1e-200]), (10, [1.0, 2.0, 3.0]), (11, [3.0, 2.0, 1.0]),
            (20, [5.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]),
            (1, [0.0, -3.0]), (30, [0.0, 0.0]), (40, None), (9, [2.0, 0.0]), (9, [7.0, 7.0])]
    got, want = collected(ann.search(frame(spark, rows), EVERY)), brute(rows)
    want = {q: v for q, v in want.items() if v}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q in got:
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert ann.search(frame(spark, rows[:0]), EVERY).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 1.0, 0.0, 0.0])] + [(i, [1.0, 1.0, 0.0, 1.0]) for i in range(100, 70, -1)]
    got = collected(ann.search(frame(spark, rows, "float"), EVERY))
    assert [i for _, i in got[0]] == list(range(71, 81))


def test_rotation_keeps_lengths_and_two_axes_work(spark, rows):
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    c = ann.codes(x, 3, 2, 50)
    assert c.shape == (5, 3, 50) and c.max() < 64 * 64 and all(len(set(p)) == 50 for r in c for p in r)
    assert ann.recall(frame(spark, rows), EVERY, axes=2, probes=100) > 0.9
