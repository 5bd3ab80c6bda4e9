import zlib
from hashlib import sha256

import pytest

from leafclock.llm import merkle
from leafclock.llm.merkle import ExternalQueue, Sweep

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, proof string, "
          "grp int, place int, digest string, n int, row string, subroot string, tampered string, name string")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, k=2):
    """The contract's columns by whole trees in memory."""
    leaves = []
    for i, text, lang, source, n in rows:
        digest = h(*map(written, (i, source, lang, n, text)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        leaves.append((lang, i, digest, h(*map(written, (i, source, lang, n + 1, text))) if hit else digest))
    leaves.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))

    def tree(level):
        paths, under = [[] for _ in level], [[j] for j in range(len(level))]
        while len(level) > 1:
            above, held = [], []
            for a in range(0, len(level), k):
                run = level[a:a + k]
                for q in range(len(run)):
                    for j in under[a + q]:
                        paths[j].append(("".join(run[:q]), "".join(run[q + 1:])))
                above.append(h(*run))
                held.append([j for u in under[a:a + k] for j in u])
            level, under = above, held
        return level[0], paths

    groups = {}
    for x in leaves:
        groups.setdefault(x[0], []).append(x)
    own = [tree([x[2] for x in xs]) for xs in groups.values()]
    root, high = tree([s for s, _ in own]) if own else (None, [])
    out = []
    for xs, (subroot, low), more in zip(groups.values(), own, high):
        for x, path in zip(xs, low):
            d = x[3]
            for a, b in path + more:
                d = h(a, d, b)
            out.append((x[1], x[2], subroot, root, h(*(a + b for a, b in path + more)), d, d == root))
    return sorted(out, key=str)


def audited(docs, **how):
    from pyspark.sql import functions as F

    got = merkle.audit(docs, **how).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("proof").cast("binary"), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", "r", "p", 1, 2, "d", 3, "w", "s", "t", "m") for r in rows], SCHEMA)


ROWS = (
    [(i, f"text {i} ü", "en", "s", i) for i in range(90)] + [(i, "", "de", None, None) for i in range(33)]
    + [(5, "lone", "fr", "s", 2), (7, "no language", None, "s", 9), (None, None, None, None, None)]
    + [(None, "no id", "en", "s", 1)] * 3 + [(4, "same id, other text", "en", "s", 1)] + [(4, "x " * 300_000, "en", "s", 5)]
    + [(2 ** 63 - 1, "last", "en", "s", 2 ** 63 - 1)])


@pytest.mark.parametrize("how", [{"height": 3}, {"arity": 3, "height": 2}, {"arity": 5, "height": 4, "hold": 4}, {}])
def test_equals_whole_trees(spark, how):
    docs = frame(spark, ROWS).repartition(5)
    assert audited(docs, **how) == brute(ROWS, how.get("arity", 2))


def test_repeated_rows_and_a_single_group(spark):
    rows = [(1, "copy", "en", "s", 4)] * 50 + [(i, "b", "en", "s", 1) for i in range(2, 30)]
    assert audited(frame(spark, rows).repartition(7), height=2) == brute(rows)


def test_lone_leaf_and_empty(spark):
    rows = [(14, "only", "en", "s", 4)]
    (got,) = audited(frame(spark, rows))
    assert got == brute(rows)[0] and got[2] == got[3] == got[1] and got[4] == h("")
    assert audited(frame(spark, [])) == []


def test_tampering_is_found(spark):
    got = audited(frame(spark, ROWS), height=4)
    for doc_id, *_, verified in got:
        same = [r for r in ROWS if r[0] == doc_id]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        if len({r[4] for r in same}) == 1:
            assert verified == (not hit or same[0][4] is None), (doc_id, hit, same[0][2:])


def test_queue_spills_sorted_runs(tmp_path):
    queue = ExternalQueue(8, str(tmp_path))
    labels = [(i * 37 % 101, i) for i in range(101)]
    for at, i in labels:
        queue.push((0, at), (i, "m"))
        queue.push((0, at), (i - 1000, "m"))
    assert queue.spilled > 5 and len(queue.heap) <= 8
    for at, i in sorted(labels):
        assert queue.take((0, at)) == [(i - 1000, "m"), (i, "m")]
    assert queue.take((0, 200)) == [] and not any(tmp_path.iterdir())


def test_sweeps_with_little_memory(tmp_path):
    leaves = [h(str(i)) for i in range(3000)]
    small, large = Sweep(2, 32, str(tmp_path)), Sweep(2, 1 << 20, str(tmp_path))
    rows = small.up(leaves, None)
    assert rows == large.up(leaves, None) and len(rows[-1]) == 1
    assert list(small.down(rows, [])) == list(large.down(rows, []))
    assert not any(tmp_path.iterdir())
