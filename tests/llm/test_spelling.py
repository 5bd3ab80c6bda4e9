import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from leafclock.llm import spelling
from leafclock.llm.spelling import Matrix, cells, cuts

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)
SCHEMA = "doc_id long, text string, word string, n int, cell string, form string, run int"


def brute(docs, shortest=6, least=5, every=199):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            x = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:x % len(w)] + w[x % len(w) + 1:] if x % every == 0 else w] += 1
    return grouped({w: n for w, n in count.items() if len(w) >= shortest and n >= least})


def single_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if single_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def variant(r, w):
    i = r.randrange(len(w) + 1)
    c = r.choice("aeéÿ×")
    return r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])


def words_of(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(n)]
    return base + [variant(r, w) for w in base for _ in range(2)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abaaaa", "aaaaab"]


def test_documents(spark):
    r = random.Random(3)
    words = words_of(1, 60)
    docs = [(i, " ".join(r.choices(words, [1 + k % 40 for k in range(len(words))], k=150)).title()) for i in range(60)]
    docs += [(None, "Straße-straße " * 6), (900, None), (901, ""), (902, "12 34"), (903, "y" * 200_000 + " " + "z" * 5000)]
    docs += [(7, "doubled doubled doubled")] * 2
    frame = spark.createDataFrame([(*d, "w", 1, "c", "f", 2) for d in docs], SCHEMA)
    got = rows(spelling.variants(frame.repartition(3), least=3, every=11))
    assert got == brute(docs, least=3, every=11)
    assert any(x[1] for x in got) and max(x[4] for x in got) > 3


def test_every_pair_once_in_any_cells(spark):
    words = {w: 1 + (k * k) % 400 for k, w in enumerate(dict.fromkeys(words_of(2, 300))) if w}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = grouped(words)
    for crowd in (1, 4, 1000):
        assert rows(spelling.group_variants(table, crowd=crowd)) == want
    placed = spelling.tiled(table, crowd=4)
    crowded = placed.where("high - low > 1").groupBy("cell").count().where("count > 4")
    assert crowded.isEmpty()


def test_one_beginning_for_all(spark):
    """Words with a common first half meet in few tiles, as their cells are cut finer."""
    r = random.Random(9)
    tails = {"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(3000)}
    words = {"commonbe" + t: 5 + k % 90 for k, t in enumerate(sorted(tails))}
    words |= {w[:-1]: 2000 for w in list(words)[:40]}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    placed = spelling.tiled(table, crowd=64)
    assert placed.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 64
    got = rows(spelling.group_variants(table, crowd=64))
    assert len(got) == len(words) and sum(x[1] is not None for x in got) >= 30
    assert {x[0]: x[1] for x in got if x[1]} == {w: w[:-1] for w in words if w[:-1] in words and 2000 >= 5 * words[w]}


def test_chains_end_at_the_last_form(spark):
    chain = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghij": 3125, "xbcdef": 24}
    table = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {x[0]: x for x in rows(spelling.group_variants(table))}
    assert {got[w][2] for w in list(chain)[:5]} == {"abcdefghij"} and got["xbcdef"][1:3] == (None, "xbcdef")


def test_empty(spark):
    assert rows(spelling.variants(spark.createDataFrame([], SCHEMA))) == []


def test_cuts_nest():
    for length in range(1, 40):
        for depth in range(1, 7):
            assert set(cuts(length, depth)) <= set(cuts(length, depth + 1))
    assert all(len(list(cells("straße", d))) for d in range(8))


def test_common_ends():
    m = Matrix(["abcé", "abé", "xbcé", "abcé"])
    a = slice(0, 4)
    assert m.common(a, a, m.left)[0].tolist() == [4, 2, 0, 4]
    assert m.common(a, a, m.right)[0].tolist() == [4, 1, 3, 4]


def test_blocks_of_any_size():
    words = sorted(dict.fromkeys(w for w in words_of(4, 80) if len(w) == 7))
    n = np.arange(len(words)) + 1
    batch = pa.RecordBatch.from_pydict({
        "cell": np.zeros(len(words), np.int64), "base": np.full(len(words), 7, np.int32),
        "low": np.zeros(len(words), np.int32), "high": np.full(len(words), 7, np.int32), "word": words, "n": n})
    whole = {w: (k, b) for w, k, _, b in spelling.compared(batch)}
    parts = defaultdict(lambda: [0, []])
    for w, k, best_n, b in spelling.compared(batch, cells_of_tile=7 * 9):
        parts[w][0] += k
        parts[w][1].append((-best_n, b))
    assert whole == {w: (k, min(b)[1]) for w, (k, b) in parts.items()}
    assert {w: k for w, (k, _) in whole.items()} == {
        w: k for w in words if (k := sum(single_edit(w, v) for v in words))}
