"""A word bigram model with interpolated modified Kneser-Ney smoothing, counted in Spark.

Words are lower-cased (A-Z) runs without white space; every text ends with one end mark,
which is a token, and begins after a start mark, which is not. Three jobs count:

1. Words: tasks sum 64-bit hashes of words, packed by parts of the hash range; each part
   is merged, sorted and saved. A word's place in the parts is its id.
2. Pairs: tasks sum pairs of ids, packed by a hash of the pair, so that a very common word
   is spread over all parts; each part is merged, sorted and saved.
3. Continuations: every part of pairs adds up, for each id, how many pairs with a count of
   1, 2, 3 or more it opens, and how many it closes; blocks of ids are merged and saved.

Parts follow the size of the corpus, so no task ever holds more than about
``part_tokens`` entries. The saved arrays lie in the shared folder; scoring tasks map them
into memory, look up the distinct words and pairs of a slice of documents, and add up

    p(w | v) = max(c(vw) - D, 0) / c(v) + gamma(v) * p(w)
    p(w)     = max(n(w) - D', 0) / n + gamma' / (V + 1)

with n(w) the number of different words before w, and discounts D, D' for counts of 1, 2
and 3 or more from the counts of counts. An unknown word takes the last term only; after an
unknown word the pair term is left out. Two words share a hash with a chance of 2 ** -64.

Defined results: a null text is empty, an empty text is one end mark; repeated rows count
as often as they occur; without training rows every probability is 1. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.llm.arrays import by_part, find, load, pack, save, summed, unpack
from leafclock.llm.common import WordHashes, fold, map_batches, mix, over_batches, slices, texts
from leafclock.sources.scratch import scratch_dir, staged

#: No word has a blank in it.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_LOW = np.uint64(0xFFFFFFFF)
_UNKNOWN = np.uint64(0xFFFFFFFF)
#: Ids of a block: 2 ** this many.
BLOCK_BITS = 18


def top(h: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of 64."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def words(batch: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by the end mark, and the texts' ends."""
    parts = []
    for text in batch:
        parts += [hashes.of(text.lower().split()), np.array([END])]
    ends = np.cumsum([len(p) for p in parts])[1::2]
    return np.concatenate(parts), ends


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of counts of 1, 2, 3 and 4; fixed ones if any is missing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


@dataclass(frozen=True)
class Model:
    folder: str
    tokens: int
    texts: int
    sizes: tuple[int, ...]  # words in each part of the hash range
    word_bits: int
    pair_bits: int
    pairs: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    spare: float  # gamma' of the continuation counts

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)


def _flushes(batches: Iterator[pa.RecordBatch], count, parts, limit: int) -> Iterator[pa.RecordBatch]:
    """Packed sums of (key, count) from slices, handed on whenever ``limit`` keys are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emit():
        keys, n = summed(*(np.concatenate(x) for x in zip(*held)))
        rows = [(p, pack(keys[i], True), pack(n[i].astype(np.uint32))) for p, i in by_part(parts(keys))]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"])

    for part in slices(batches):
        held.append(count(texts(part)))
        if sum(len(k) for k, _ in held) > limit:
            yield emit()
            held = []
    if held:
        yield emit()


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(k.as_py(), np.uint64, True) for k in table["keys"]]
    counts = [unpack(c.as_py(), np.uint32).astype(np.uint64) for c in table["counts"]]
    return summed(np.concatenate(keys), np.concatenate(counts))


class Words:
    """The saved words, mapped; finds ids and counts."""

    def __init__(self, folder: str, sizes: tuple[int, ...], bits: int):
        self.bits, self.starts = bits, np.cumsum([0, *sizes])
        self.keys = [load(f"{folder}/word-{p}", np.uint64) if n else np.zeros(0, np.uint64) for p, n in enumerate(sizes)]
        self.counts = [load(f"{folder}/count-{p}", np.uint64) if n else np.zeros(0, np.uint64) for p, n in enumerate(sizes)]

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of distinct hashes; an unknown one has count 0."""
        ids, counts = np.full(len(h), _UNKNOWN), np.zeros(len(h), np.uint64)
        for p, i in by_part(top(h, self.bits)):
            at, known = find(self.keys[p], h[i])
            i, at = i[known], at[known]
            ids[i], counts[i] = np.uint64(self.starts[p]) + at.astype(np.uint64), self.counts[p][at]
        return ids, counts


_words: dict[str, Words] = {}
_scorers: dict[str, _Scorer] = {}


def _kept(cache: dict, key: str, make):
    """One model at a time stays open in a worker."""
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


def _pair_keys(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    before = np.concatenate([[np.uint64(start)], ids[:-1]])
    before[ends[:-1]] = np.uint64(start)
    return (before << np.uint64(32)) | ids


def fit(docs: DataFrame, *, part_tokens: int = 4_000_000, flush: int = 3_000_000) -> Model:
    """The model of all texts of ``docs``."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "ngrams")
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    n_texts = size.rows
    bits = lambda n: max(0, ceil(log2(max(1.0, n))))
    word_bits = bits((size.n or 0) / 6 / (4 * part_tokens))

    def count_words(batches):
        hashes = WordHashes()

        def count(batch):
            h, _ = words(batch, hashes)
            return tuple(x.astype(np.uint64) for x in np.unique(h, return_counts=True))

        return _flushes(batches, count, lambda k: top(k, word_bits), flush)

    def save_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        part = key[0].as_py()
        save(f"{folder}/word-{part}", keys)
        save(f"{folder}/count-{part}", counts)
        return pa.table({"part": [part], "n": [len(keys)], "tokens": [int(counts.sum())]})

    packed = "part int, keys binary, counts binary"
    got = map_batches(docs, count_words, packed).groupBy("part").applyInArrow(
        save_words, "part long, n long, tokens long").collect()
    sizes = [0] * (1 << word_bits)
    for r in got:
        sizes[r.part] = r.n
    sizes, tokens = tuple(sizes), sum(r.tokens for r in got)
    start = sum(sizes)
    if start >= int(_UNKNOWN):
        raise ValueError("more than 2 ** 32 - 2 different words")
    pair_bits = bits(tokens / part_tokens)

    def count_pairs(batches):
        hashes, known = WordHashes(), _kept(_words, folder, lambda: Words(folder, sizes, word_bits))

        def count(batch):
            h, ends = words(batch, hashes)
            distinct, at = np.unique(h, return_inverse=True)
            keys = _pair_keys(known.of(distinct)[0][at], ends, start)
            return tuple(x.astype(np.uint64) for x in np.unique(keys, return_counts=True))

        return _flushes(batches, count, lambda k: top(mix(k), pair_bits), flush)

    def save_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        part = key[0].as_py()
        save(f"{folder}/pair-{part}", keys)
        save(f"{folder}/pairs-{part}", counts.astype(np.uint32) if counts.max(initial=0) >> np.uint64(32) == 0 else counts)
        kinds = [(counts == k).astype(np.uint32) for k in (1, 2, 3, 4)]
        ones, twos, more = kinds[0], kinds[1], (counts > 2).astype(np.uint32)
        zero = np.zeros(0, np.uint32)
        first, n1, n2, n3 = summed(keys >> np.uint64(32), ones, twos, more)
        last, closed = summed(keys & _LOW, np.ones(len(keys), np.uint32))
        rows = []
        for ids, values in ((first, (n1, n2, n3, zero)), (last, (zero, zero, zero, closed))):
            for block, i in by_part((ids >> np.uint64(BLOCK_BITS)).astype(np.int64)):
                rows.append((block, pack(ids[i], True), *(pack(v[i].astype(np.uint32)) if len(v) else None for v in values)))
        meta = [len(keys), *(int(k.sum()) for k in kinds)]
        return pa.table([
            pa.array([*(r[0] for r in rows), -1], pa.int32()),
            *(pa.array([*(r[k] for r in rows), None], pa.binary()) for k in range(1, 6)),
            pa.array([*([None] * len(rows)), meta], pa.list_(pa.int64())),
        ], names=["block", "ids", "n1", "n2", "n3", "closed", "meta"])

    opened = staged(map_batches(docs, count_pairs, packed).groupBy("part").applyInArrow(
        save_pairs, "block int, ids binary, n1 binary, n2 binary, n3 binary, closed binary, meta array<long>"), "pairs")
    meta = opened.where("block < 0").agg(*(F.sum(F.col("meta")[k]) for k in range(5))).first()
    pairs, *of_pairs = (int(x or 0) for x in meta)

    def save_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        total = np.zeros((4, 1 << BLOCK_BITS), np.uint32)
        for r in table.to_pylist():
            ids = (unpack(r["ids"], np.uint64, True) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            for k, name in enumerate(("n1", "n2", "n3", "closed")):
                if r[name] is not None:
                    total[k, ids] += unpack(r[name], np.uint32)
        save(f"{folder}/block-{block}", total)
        return pa.table({"n": [[int((total[3] == k).sum()) for k in (1, 2, 3, 4)] + [int((total[3] > 2).sum())]]})

    got = opened.where("block >= 0").drop("meta").groupBy("block").applyInArrow(save_block, "n array<long>").collect()
    n = np.array([r.n for r in got]).reshape(-1, 5).sum(axis=0)
    d1 = discounts(n[:4])
    spare = float(np.dot(d1, (n[0], n[1], n[4]))) / max(pairs, 1)
    return Model(folder, tokens, n_texts, sizes, word_bits, pair_bits, pairs, discounts(of_pairs), d1, spare)


class _Scorer:
    """Maps a model's arrays and scores slices of documents."""

    def __init__(self, m: Model):
        self.m, self.words = m, Words(m.folder, m.sizes, m.word_bits)
        self.pairs: dict[int, tuple] = {}
        self.blocks: dict[int, np.ndarray] = {}
        self.d2, self.d1 = np.array([0.0, *m.d2]), np.array([0.0, *m.d1])

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for p, i in by_part(top(mix(keys), self.m.pair_bits)):
            if p not in self.pairs:
                f = self.m.folder
                try:
                    keys_of, raw = load(f"{f}/pair-{p}", np.uint64), load(f"{f}/pairs-{p}", np.uint8)
                    # Four bytes a count, or eight where one of the part needs them.
                    self.pairs[p] = keys_of, raw.view(f"u{len(raw) // max(len(keys_of), 1) or 4}")
                except FileNotFoundError:  # no pair fell into this part
                    self.pairs[p] = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            held, counts = self.pairs[p]
            at, known = find(held, keys[i])
            out[i[known]] = counts[at[known]]
        return out

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        """Rows n1, n2, n3, closed of distinct ids; zeros for an unknown word."""
        out = np.zeros((4, len(ids)))
        known = np.flatnonzero(ids != _UNKNOWN)
        for b, i in by_part((ids[known] >> np.uint64(BLOCK_BITS)).astype(np.int64)):
            if b not in self.blocks:
                self.blocks[b] = load(f"{self.m.folder}/block-{b}", np.uint32).reshape(4, -1)
            i = known[i]
            out[:, i] = self.blocks[b][:, (ids[i] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)]
        return out

    def score(self, batch: list[bytes], hashes: WordHashes):
        """(tokens, known tokens, add-one log10, log10) of each text."""
        m, v1 = self.m, self.m.vocabulary + 1
        h, ends = words(batch, hashes)
        distinct, at = np.unique(h, return_inverse=True)
        ids, counts = self.words.of(distinct)
        base = np.log10((counts.astype(float) + 1) / (m.tokens + v1))
        starts = np.concatenate([[0], ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        n_known, base_score = add((counts > 0)[at].astype(np.int64)), add(base[at])
        if not m.tokens:
            return ends - starts, n_known, base_score, np.zeros(len(batch))

        start = np.uint64(m.vocabulary)
        stats = self.continuations(np.append(ids, start))
        closed = stats[3, :-1]
        lower = np.maximum(closed - self.d1[np.minimum(closed, 3).astype(int)], 0) / m.pairs + m.spare / v1
        held = np.append(counts.astype(float), float(m.texts))
        open_ = np.where(held > 0, stats[:3].T @ self.d2[1:] / np.maximum(held, 1), 1.0)
        # Places of the words before, by distinct word; the start mark is the last one.
        before = np.concatenate([[len(ids)], at[:-1]])
        before[starts] = len(ids)
        pairs, back = np.unique((before.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64), return_inverse=True)
        v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & _LOW).astype(np.int64)
        all_ids = np.append(ids, start)
        both = (all_ids[v] != _UNKNOWN) & (ids[w] != _UNKNOWN)
        c = np.zeros(len(pairs), np.int64)
        c[both] = self.pair_counts((all_ids[v[both]] << np.uint64(32)) | ids[w[both]])
        p = np.maximum(c - self.d2[np.minimum(c, 3)], 0) / np.maximum(held[v], 1) + open_[v] * lower[w]
        return ends - starts, n_known, base_score, add(np.log10(p)[back])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _kept(_scorers, model.folder, lambda: _Scorer(model))
        n, known, base, s = scorer.score(texts(batch), hashes)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
            pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(s),
            pa.array(10 ** np.minimum(-s / n, 300))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    hashes = WordHashes()
    return over_batches(
        docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double")


def score_held_out(docs: DataFrame, parts: int = 7, held: int = 2, **how) -> DataFrame:
    """Scores of all rows by the model of those whose fold of ``parts`` is not ``held``."""
    model = fit(docs.where(fold("doc_id", parts) != held), **how)
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"),
                         *(c for c in scored.columns if c != "doc_id"))
