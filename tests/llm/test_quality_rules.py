import random
import re
from collections import Counter

import numpy as np
import pytest

from leafclock.llm import quality_rules as qr
from leafclock.llm.ngram_lm import discounts


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
    marked = {i for j in range(len(w) - 4) if windows[tuple(w[j:j + 5])] > 1 for i in range(j, j + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.fixture(scope="module")
def rows(prose):
    r = random.Random(9)
    out = [(i, prose(i, 20 + i % 60), r.choice(["en", "de", None])) for i in range(300)]
    for i in range(300, 330):
        out.append((i, " ".join("".join(r.choice("qxzjkw#$") for _ in range(9)) for _ in range(60)), "en"))
    line = prose(7, 6)
    out += [(400, None, "en"), (401, "", None), (402, " \n\t ", "en"), (403, "kaba lodi", "en"), (404, "\n".join([line] * 9), "en"),
            (405, "é ü | <b> & %" * 5, "xx"), (406, "kaba mino tudi " * 20_000, "de"), (None, prose(1, 30), "en"), (8, out[8][1], out[8][2])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, "k", 0.5) for i, t, x in rows],
                                 "doc_id long, text string, lang string, n_words int, kept string, value double")


def test_measures_and_bands(spark, rows):
    got = qr.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(brute_measures(t))
    for r in got:
        m = tuple(r[n] for n in qr.NAMES)
        assert m in want[r.doc_id]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(300))) >= 297
    assert not kept & set(range(300, 330))
    again = qr.judge(frame(spark, rows).repartition(3)).collect()
    assert {(r.doc_id, r.kept) for r in again} == {(r.doc_id, r.kept) for r in got}


def brute_word(words, order, word):
    """Interpolated modified Kneser-Ney over the bytes of one word, from a Counter of words."""
    pad = b"\t" * (order - 1)
    levels = {order: Counter()}
    for w, n in words.items():
        s = pad + w + b"\n"
        for i in range(len(w) + 1):
            levels[order][s[i:i + order]] += n
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: (0, *discounts([sum(n == i for n in levels[k].values()) for i in (1, 2, 3, 4)])) for k in levels}

    def p(g):
        if not g:
            return 1 / 257
        k = len(g)
        own = {x: n for x, n in levels[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, n = sum(own.values()), own.get(g, 0)
        share = (n - cuts[k][min(n, 3)]) / total if n else 0
        return share + sum(cuts[k][min(x, 3)] for x in own.values()) / total * p(g[1:])

    s = pad + word + b"\n"
    return sum(np.log(p(s[i:i + order])) for i in range(len(word) + 1))


def test_word_scores_equal_brute_force(spark, prose):
    counts = Counter(w.encode() for w in (prose(3, 80) + " Zebra é kaba").split())
    words = spark.createDataFrame([("=en", bytearray(w), n) for w, n in counts.items()], "lang string, word binary, n long")
    table = qr.word_table(words, qr.fit(words, 3, True), 3, True, 0.5)
    p = qr.Perplexity(table)
    for w in counts:
        n, value = p.of(["=en"], [[w]])
        assert n[0] == len(w) + 1
        assert -value[0] * n[0] == pytest.approx(brute_word(counts, 3, w), rel=1e-5)


def test_bags_hold_every_word_of_every_text(spark, rows):
    """Whatever the bags' bounds: counts, measures and scores are those of the texts taken one by one."""
    docs = qr._languages(frame(spark, rows))
    table = None
    for bounds in ({}, {"keep": 1}, {"most": 1}):
        blocks = qr.bags(docs.repartition(2), **bounds).cache()
        want = Counter((f"={x}" if x else "?", w) for _, t, x in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        words = qr.word_counts(blocks)
        assert {(r.lang, bytes(r.word).decode()): r.n for r in words.collect()} == want
        table = table or qr.word_table(words, qr.fit(words, 3, False), 3, False, 0.5)
        p = qr.Perplexity(table)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.lang, r.size, r.log_ppl, *(r[n] for n in qr.NAMES))
                     for r in qr.log_perplexities(blocks, table).where("log_ppl is not null").collect())
        expected = []
        for i, t, x in rows:
            lang = f"={x}" if x else "?"
            size, value = p.of([lang], [(t or "").encode().split()])
            if size[0]:
                expected.append((i is None, i or 0, lang, int(size[0]), pytest.approx(value[0], rel=1e-9), *brute_measures(t)))
        assert got == sorted(expected, key=lambda r: r[:4])
        assert qr.log_perplexities(blocks, table).where("log_ppl is null").count() == 3
        blocks.unpersist()


def test_only_chosen_texts_are_counted(spark):
    docs = spark.createDataFrame([(1, "a b a", "=en"), (2, "a c", "=en"), (3, "", "=en"), (4, "d", "=de")], "doc_id long, text string, lang string")
    odd = lambda block: np.array(block.columns["doc_id"].to_numpy()) % 2 == 1
    got = qr.word_counts(qr.bags(docs.coalesce(1)), odd).collect()
    assert {(r.lang, bytes(r.word), r.n) for r in got} == {("=en", b"a", 2), ("=en", b"b", 1)}


def test_no_rows(spark, rows):
    assert qr.judge(frame(spark, rows).limit(0)).count() == 0
    got = qr.judge(frame(spark, [(1, None, None), (2, "", "en")])).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in got] == [(0, True, False)] * 2


def test_garbage_of_letters_and_lower_case_teaches_nothing(spark, rows, prose):
    """Prose with a mark of neither symbols, capitals nor repeated neighbours between its words."""
    planted = [(1000 + i, " ".join(f"{w} {m}" for w in prose(1000 + i, 25).split()), "en") for i, m in enumerate(["@@@", "~~"] * 12)]
    got = qr.judge(frame(spark, rows + planted)).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {i for i, _, _ in planted}
    assert len(kept & set(range(300))) >= 297
    assert sum(not r.base_failed for r in got if (r.doc_id or 0) >= 1000) >= 12


def test_unusually_predictable_text_goes(spark):
    """Texts of the commonest words only, in no repeated order."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(words, weights, k=400)), "en") for i in range(150)]
    rows += [(1000 + i, " ".join(r.choices(words[:15], k=300)), "en") for i in range(4)]
    got = {x.doc_id: x for x in qr.judge(frame(spark, rows)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 147
    for i in range(1000, 1004):
        x = got[i]
        assert x.log_ppl < x.low and not x.kept and not x.base_failed
        middle = x.low + (x.high - x.low) / 3
        assert x.log_ppl > 2 * middle - x.high  # a lower side as wide as the upper one would keep it
