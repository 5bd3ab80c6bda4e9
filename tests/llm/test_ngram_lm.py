import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafclock.llm import arrays, ngram_lm


def brute(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b" end"]
    train = [tokens(t) for i, t in rows if (zlib.crc32(str(i).encode()) if i is not None else 0) % 7 != 2]
    c = Counter(w for x in train for w in x)
    total, v = sum(c.values()), len(c)
    pairs = Counter(p for x in train for p in zip([None, *x], x))
    d2 = (0, *ngram_lm.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    closed = Counter(b for _, b in pairs)
    d1 = (0, *ngram_lm.discounts([sum(n == k for n in closed.values()) for k in (1, 2, 3, 4)]))
    opened = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in pairs.items():
        opened[a][0] += n
        opened[a][min(n, 3)] += 1
    spare = sum(d1[min(n, 3)] for n in closed.values()) / max(len(pairs), 1)
    out = []
    for i, t in rows:
        x, s = tokens(t), 0.0
        for a, b in zip([None, *x], x):
            p = max(closed[b] - d1[min(closed[b], 3)], 0) / max(len(pairs), 1) + spare / (v + 1)
            if a in opened:
                o, n = opened[a], pairs.get((a, b), 0)
                p = max(n - d2[min(n, 3)], 0) / o[0] + sum(d2[k] * o[k] for k in (1, 2, 3)) / o[0] * p
            s += math.log10(p) if total else 0
        out.append((i is None, i or 0, len(x), sum(c[w] > 0 for w in x), total,
                    sum(math.log10((c[w] + 1) / (total + v + 1)) for w in x), s))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"part_tokens": 100, "flush": 50}])
def test_equals_brute_force(frame, prose, how):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Unseen WORDS mixed ka"), (503, "loba " * 20_000), (None, "kaba lodi"), (3, rows[3][1])]
    got = ngram_lm.score_held_out(frame(rows), **how).collect()
    want = brute(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_counts_beyond_32_bits_keep_their_width(frame, prose):
    """A part whose counts need eight bytes is read with eight, others with four."""
    model = ngram_lm.fit(frame([(i, prose(i, 30)) for i in range(20)]))
    keys = arrays.load(f"{model.folder}/pair-0", np.uint64)
    counts = arrays.load(f"{model.folder}/pairs-0", np.uint32).astype(np.uint64)
    assert len(keys) == len(counts) > 10 and model.pair_bits == 0
    assert ngram_lm._Scorer(model).pair_counts(keys).tolist() == counts.tolist()
    counts[3] = 5 << 32
    arrays.save(f"{model.folder}/pairs-0", counts)
    assert ngram_lm._Scorer(model).pair_counts(keys).tolist() == counts.tolist()


def test_probabilities_sum_to_one(frame, prose):
    """Over all words and the unknown one, after any word."""
    rows = [(i, prose(i, 30)) for i in range(30)]
    model = ngram_lm.fit(frame(rows).where("doc_id < 25"), part_tokens=100)
    scorer = ngram_lm._Scorer(model)
    vocabulary = sorted({w for i, t in rows[:25] for w in t.split()})
    assert model.vocabulary == len(vocabulary) + 1
    h = ngram_lm.WordHashes()
    first = "kaba"
    alone = scorer.score([first.encode()], h)[3][0]
    # p(w | first) = score(first w) - what follows w, so compare texts that differ in w alone.
    total = 0.0
    for w in [*vocabulary, "never-seen"]:
        total += 10 ** (scorer.score([f"{first} {w}".encode()], h)[3][0] - scorer.score([w.encode()], h)[3][0]
                        + start(scorer, w, h) - start(scorer, first, h))
    end = 10 ** (alone - start(scorer, first, h))
    assert total + end == pytest.approx(1, abs=1e-6)


def start(scorer, word, hashes):
    """log10 p(word | start)."""
    both = scorer.score([word.encode(), f"{word} qqq".encode(), b"qqq"], hashes)[3]
    # word qqq END: p(word|s) p(qqq|word) p(END|qqq); solved with the tables themselves
    m, d2 = scorer.m, scorer.d2
    ids, counts = scorer.words.of(np.array([hashes[word.encode()]], np.uint64))
    stats = scorer.continuations(np.array([ids[0], np.uint64(m.vocabulary)], np.uint64))
    closed = stats[3, 0]
    lower = max(closed - scorer.d1[int(min(closed, 3))], 0) / m.pairs + m.spare / (m.vocabulary + 1)
    c = scorer.pair_counts(np.array([(m.vocabulary << 32) | int(ids[0])], np.uint64))[0] if counts[0] else 0
    assert len(both) == 3
    return math.log10(max(c - d2[min(c, 3)], 0) / m.texts + float(stats[:3, 1] @ d2[1:]) / m.texts * lower)


def test_empty_table(frame):
    assert ngram_lm.score_held_out(frame([])).count() == 0
    got = ngram_lm.score(frame([(1, "a b")]), ngram_lm.fit(frame([]))).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_packing():
    r = np.random.default_rng(0)
    x = np.sort(r.integers(0, 1 << 60, 1000).astype(np.uint64))
    assert (arrays.unpack(arrays.pack(x, True), np.uint64, True) == x).all()
    y = r.integers(0, 1 << 30, 1000).astype(np.uint32)
    assert (arrays.unpack(arrays.pack(y), np.uint32) == y).all()
    assert len(arrays.unpack(arrays.pack(x[:0], True), np.uint64, True)) == 0


def test_saved_arrays_by_address(tmp_path):
    for place in (f"{tmp_path}/a", f"file://{tmp_path}/b", f"file:{tmp_path}/c"):
        arrays.save(place, np.arange(5))
        arrays.save(place, np.arange(6))
        assert arrays.load(place, np.int64).tolist() == list(range(6))
    arrays.save(f"{tmp_path}/none", np.zeros(0))
    assert len(arrays.load(f"{tmp_path}/none", np.int64)) == 0
