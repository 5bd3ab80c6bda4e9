import random

import pytest
from pyspark.sql import functions as F

from leafclock.llm import minhash, mixing, quality_classifier, toxicity
from leafclock.llm.components import components
from leafclock.llm.shingles import least_matches, tail


def brute(rows, width, percent):
    """Set sizes and components from all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j:j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def run(df, width, percent, **how):
    got = minhash.near_duplicates(df, width=width, percent=percent, **how).collect()
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)


@pytest.fixture(scope="module")
def rows(prose):
    r = random.Random(3)
    out, i = [], 0
    for g in range(12):
        base = prose(g, 120).split()
        for _ in range(r.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append((i, " ".join(w)))
            i += 3
    # a chain whose ends are not alike, and a group around a centre that has the largest id
    chain = prose(99, 200).split()
    for k in range(10):
        out.append((i + 1, " ".join(chain[5 * k:5 * k + 150])))
        i += 3
    out += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "one"), (10_004, "ONE"), (10_005, "one two"),
            (10_006, "Éa b c"), (10_007, "éa b c"), (10_008, "x " * 30_000), (10_009, "X " * 30_001),
            (10_010, "no break here"), (10_010, "no break here")]
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [512, 4])
def test_same_components_as_all_pairs(frame, rows, width, percent, block):
    assert run(frame(rows), width, percent, block=block) == brute(rows, width, percent)


def test_empty_table(frame):
    assert run(frame([]), 5, 80) == []
    assert minhash.keep_one(frame([])).count() == 0


def test_null_ids(frame, prose):
    rows = [(None, prose(1, 50)), (4, prose(1, 50)), (None, prose(2, 50)), (None, prose(2, 50)), (None, None), (None, "")]
    assert run(frame(rows), 5, 80) == brute([r if r[1] else (r[0], None) for r in rows], 5, 80)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(frame(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(4, prose(1, 50)), (None, prose(2, 50)), (None, None), (None, "")], key=str)


def test_keep_one(frame, rows):
    """One row of each group; a repeated id keeps a row of each of its unlike texts."""
    df = frame(rows + [(3, "another text under an old id")] * 2)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(set(kept)) or any(not (t or "").split() for _, t in kept)
    want = {c for _, d, _, c in brute(rows, 5, 80) if d == c}
    ids = [i for i, t in kept if t != "another text under an old id"]
    assert sorted(ids) == sorted(want) and kept.count((3, "another text under an old id")) == 1


def test_clashing_names_survive(spark, prose):
    names = ["_own", "_key", "_place", "_size", "_nth", "_copy", "_score", "cid", "n", "sig", "root", "words", "at", "odd name"]
    rows = [(i, prose((9 if i is None else i) // 2, 40), "a", *range(k, k + len(names))) for k, i in enumerate([0, 1, 2, 2, 4, None, None])]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    whole = {tuple(r) for r in docs.collect()}
    outs = [minhash.keep_one(docs), mixing.mixed(docs), quality_classifier.keep_good(docs, labels), toxicity.keep_clean(docs, labels)]
    for out in outs:
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= whole
    assert sorted((r.doc_id for r in outs[0].collect()), key=str) == [0, 2, 4, None]


def test_many_null_ids_are_linear_work(spark, prose):
    """Rows without an id meet their own class only, not every class without an id."""
    n = 1500
    rows = [(None, f"{prose(i // 2, 30)} {'tail' if i % 2 else 'end'}{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash.signatures(docs, 5, 160).groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    sets = minhash._sets(docs, classes, 5)
    assert sets.count() == n
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "<=>" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert minhash.near_duplicates(docs).select("n_shingles").count() == n


def test_hub_with_many_members_is_dealt_in_blocks(frame, prose):
    r = random.Random(8)
    base = prose(7, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([4, 6, 9])):  # far enough from each other to need the second comparison
            w[r.randrange(len(w))] = f"n{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    assert run(frame(rows), 3, 85, block=16) == brute(rows, 3, 85)


def test_rule_is_safe_and_useful():
    rule = dict(least_matches(160, 16, 0.85, 1e-6))
    for n, m in rule.items():
        assert m == 0 or tail(m - 1, n, 0.85) < 1e-6 <= tail(m, n, 0.85)
    assert rule[160] > 100


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 8), (8, 7), (9, 9)] + [(20, 20 + i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {2: 1, 3: 1, 8: 7, **{20 + i: 20 for i in range(1, 50)}, **{i: 100 for i in range(101, 141)}}
