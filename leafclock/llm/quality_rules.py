"""Quality rules with bands of character n-gram perplexity for each language.

Base rules count words, repeats and symbols. What passes them is judged by an interpolated
modified Kneser-Ney model over the characters (bytes) of words, ``order`` at a time, each
word between start marks and an end mark, so a word's probability does not depend on its
neighbours.

Spark counts twice. First the words of all documents make a rough model for each language;
it gives every document a perplexity. Then the words of the documents within ``trim``
deviations of their language's median, the unremarkable ones, make the final models: one
for each language and one for all together (the pool). No rule on characters decides what
teaches. A word counts with its language's probability or, where that is more, with the
pool's divided by ``e ** foreign``, so passages in another known language stay cheap and
garbage does not.

A document is kept if its log perplexity lies at most ``width`` deviations above and
``below`` deviations below the median of its language; deviations are median absolute ones
times 1.4826. Foreign and rare words lengthen the upper side only, so the lower one is
narrower. For texts of few characters the band is wider, by sqrt(1 + short / characters).

Texts are read once. Their words are numbered and written as bags: a row has the different
words of many texts of a language, and for every text its measures and its words' numbers
in order. Both counts and both sets of perplexities come from the bags, where a text is
a run of numbers and its score a sum of look-ups.

The models are rows (language, gram, value) made by joins and aggregations, dealt by hash
and saved as sorted hash arrays in the shared folder, in as many parts as they have grams
for: a value is the discounted share of a gram, or the weight that a context leaves to
shorter ones. With either set of models every distinct word of the corpus is scored once,
and saved in the same form. Workers map the arrays into memory.

Defined results: a null text has no words; without words or with too few the base rule fails; a
null language is a language of its own; repeated rows are judged alike; a language none of
whose documents pass has no band, and nothing of it is kept anyway. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafclock.llm.arrays import by_part, pack, summed, unpack
from leafclock.llm.common import map_batches, mix, over_batches, slices, texts
from leafclock.llm.ngram_lm import discounts
from leafclock.llm.tables import Reader, Table, part_bits, reader, saved
from leafclock.sources.scratch import staged

#: Symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
#: The model over all languages.
POOL = "*"
#: Start marks fill a context, the end mark closes a word; white space is in no word.
START, END = b"\t", b"\n"
_WINDOW = 5


#: Bytes that start no character of a word: white space, and what continues a UTF-8 character.
_WHITE = b" \t\n\v\f\r"
_NO_STARTS = _WHITE + bytes(b for b in range(256) if b & 0xC0 == 0x80)
#: Odd, so that no word of a window is lost in its hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers words in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeated_words(numbers: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Of each text, the words in windows of five that it has twice or more, the first included.

    ``numbers`` are the words' numbers, text after text, ``sizes`` the words of each.
    """
    h = mix(numbers.astype(np.uint64))
    code = h[:max(0, len(h) - _WINDOW + 1)]
    for k in range(1, _WINDOW):
        code = code * _STEP + h[k:k + len(code)]
    out, start = [], 0
    for size in sizes.tolist():
        own = code[start:start + max(0, size - _WINDOW + 1)]
        start += size
        ranked = np.sort(own)
        if len(own) < 2 or not (ranked[1:] == ranked[:-1]).any():
            out.append(0)
            continue
        _, at, count = np.unique(own, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[at] > 1)
        mark = np.zeros(size + 1, np.int64)
        mark[starts] += 1
        mark[starts + _WINDOW] -= 1
        out.append(int((np.cumsum(mark[:-1]) > 0).sum()))
    return out


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measures(batch: list[bytes], numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts, a row each."""
    rows = [
        (size, len(text.translate(None, _NO_STARTS)), len(text.translate(None, _OTHERS)), _dup_lines(text), repeats)
        for text, size, repeats in zip(batch, sizes.tolist(), repeated_words(numbers, sizes))
    ]
    return np.array(rows, np.int64).reshape(-1, 5)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _languages(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) with null told from every name, as the pool is."""
    return docs.select("doc_id", "text", _lang().alias("lang"))


def _lang() -> Column:
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit("?"))


class _Bag:
    """Texts of one language, their words numbered in the order of their coming."""

    def __init__(self):
        self.number, self.words = _Numbers(), 0
        self.doc_ids: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.columns: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, batch: list[bytes]) -> None:
        lists = [t.split() for t in batch]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.uint32, int(sizes.sum()))
        size = [n + len(t.translate(None, _WHITE)) for n, t in zip(sizes.tolist(), batch)]
        self.doc_ids.append(doc_ids)
        self.columns.append(np.column_stack([np.array(size, np.int64), measures(batch, numbers, sizes)]))
        text = np.repeat(np.arange(len(lists), dtype=np.uint64), sizes) << np.uint64(32)
        self.numbers.append(np.sort(text | numbers).astype(np.uint32))
        self.words += len(numbers)

    def row(self, lang: str) -> pa.RecordBatch:
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.number))
        numbers = pack(np.concatenate(self.numbers), rising=True)
        columns = [pa.concat_arrays(self.doc_ids), *(pa.array(c) for c in np.concatenate(self.columns).T)]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([words], pa.binary()), pa.array([numbers], pa.binary()),
             *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns)],
            ["lang", "words", "numbers", "doc_id", "size", *NAMES])


def bags(rows: DataFrame, keep: int = 200_000, most: int = 4_000_000) -> DataFrame:
    """Bags of whole texts (doc_id, text, lang): a row has many texts of a language.

    ``words`` are its different words, ``numbers`` those of each text in order; ``size`` is in
    bytes that a model scores, which are the words' and one end mark each. A task writes its
    rows whenever it holds ``keep`` different words or ``most`` words, after a whole slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Bag] = {}
        for part in slices(batches):
            t = texts(part)
            for lang, own in _by_lang(part):
                held.setdefault(lang, _Bag()).add(part.column("doc_id").take(pa.array(own)), [t[i] for i in own.tolist()])
            if sum(len(b.number) for b in held.values()) > keep or sum(b.words for b in held.values()) > most:
                yield from (bag.row(lang) for lang, bag in held.items())
                held.clear()
        yield from (bag.row(lang) for lang, bag in held.items())

    numbers = "".join(f", {n} array<long>" for n in ("doc_id", "size", *NAMES))
    return map_batches(rows.select("doc_id", "text", "lang"), run, f"lang string, words binary, numbers binary{numbers}")


@dataclass
class Block:
    """A row of ``bags``, opened."""

    lang: str
    words: list[bytes]
    numbers: np.ndarray
    columns: dict[str, pa.Array]

    @property
    def n_words(self) -> np.ndarray:
        return self.columns["n_words"].to_numpy()

    def log_perplexities(self, perplexity: Perplexity) -> np.ndarray:
        """The negative log probability of a byte of each text, nan without words."""
        n, size = self.n_words, self.columns["size"].to_numpy()
        values = perplexity.words(self.lang, self.words)
        total = np.bincount(np.repeat(np.arange(len(n)), n), values[self.numbers], len(n))
        return np.where(size > 0, -total / np.maximum(size, 1), np.nan)


def _over_blocks(blocks: DataFrame, fn: Callable[[Block], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield fn(Block(
                    row.column("lang")[0].as_py(), zstandard.ZstdDecompressor().decompress(row.column("words")[0].as_py()).split(),
                    unpack(row.column("numbers")[0].as_py(), np.uint32, rising=True),
                    {n: row.column(n).flatten() for n in ("doc_id", "size", *NAMES)}))

    return map_batches(blocks, run, schema)


def word_counts(blocks: DataFrame, chosen: Callable[[Block], np.ndarray] | None = None) -> DataFrame:
    """(lang, word, n) over the bags, or over those of their texts that ``chosen`` marks."""

    def run(block: Block) -> pa.RecordBatch:
        numbers = block.numbers if chosen is None else block.numbers[np.repeat(chosen(block), block.n_words)]
        count = np.bincount(numbers, minlength=len(block.words)).astype(np.int64)
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array([block.lang] * len(at), pa.string()), pa.array([block.words[i] for i in at.tolist()], pa.binary()),
             pa.array(count[at])], ["lang", "word", "n"])

    counted = _over_blocks(blocks, run, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _seed(*of) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(of).encode()))


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the words and their end marks with the ``order`` - 1 before it, as numbers, and the words' ends."""
    data = np.frombuffer(b"".join(START * (order - 1) + w + END for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths + order - 1) - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    code = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        code = (code << np.uint64(8)) | data[at - k]
    return code, np.cumsum(lengths)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(language, positions) of each language of a batch."""
    names = batch.column("lang").dictionary_encode()
    for k, own in by_part(names.indices.to_numpy()):
        yield names.dictionary[k].as_py(), own


def _gram_keys(lang: str, kind: str, k: int, code: np.ndarray) -> np.ndarray:
    return mix(code ^ _seed(lang, kind, k))


def fit(words: DataFrame, order: int, pool: bool) -> Table:
    """Character models from (lang, word, n), one for each language and with ``pool`` one for all.

    Highest-order grams count by the words' counts, shorter ones by the different
    characters before them. The table has, for every gram, its discounted share, and for
    every context the weight that is left to shorter ones.
    """
    spark = words.sparkSession

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
        out = []
        for lang, own in _by_lang(batch):
            code, ends = grams(words[own].tolist(), order)
            code, total = summed(code, np.repeat(n[own], np.diff(ends, prepend=0)))
            out.append((pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(total)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], ["lang", "gram", "n"])

    full = over_batches(words, count, "lang string, gram long, n long", gather=100_000)
    if pool:
        full = full.union(full.select(F.lit(POOL), "gram", "n"))
    level = staged(full.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    entries, size = [], 0
    for k in range(order, 0, -1):
        if k < order:
            level = staged(level.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(
                F.count("*").alias("n")), "grams")
        of = level.groupBy("lang").agg(
            F.count("*").alias("grams"), *(F.count_if(F.col("n") == i).alias(f"k{i}") for i in (1, 2, 3, 4))).collect()
        size += 2 * sum(r.grams for r in of)  # there are no more contexts than grams
        # One row of three numbers for each language.
        d = spark.createDataFrame(
            [(r.lang, *discounts([r.k1, r.k2, r.k3, r.k4])) for r in of] or [("", 0.0, 0.0, 0.0)],
            "lang string, d1 double, d2 double, d3 double").coalesce(1)
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(d, "lang").select("lang", "gram", F.shiftrightunsigned("gram", 8).alias("context"), "n", cut.alias("cut"))
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        entries.append(rows.join(sums, ["lang", "context"]).select(
            "lang", F.lit(2 * k).alias("level"), "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("value")))
        entries.append(sums.select("lang", F.lit(2 * k + 1).alias("level"), F.col("context").alias("gram"),
                                   (F.col("left") / F.col("total")).alias("value")))
    rows = entries[0]
    for e in entries[1:]:
        rows = rows.union(e)

    def keyed(batch: pa.RecordBatch):
        code = batch.column("gram").to_numpy().view(np.uint64)
        level, keys = batch.column("level").to_numpy(), np.empty(len(code), np.uint64)
        for lang, own in _by_lang(batch):
            for x, i in by_part(level[own]):
                i = own[i]
                keys[i] = _gram_keys(lang, "context" if x % 2 else "share", x // 2, code[i])
        return keys, batch.column("value").to_numpy()

    return saved(rows, keyed, part_bits(size))


def _word_scores(own: Reader, lang: str, code: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Log probabilities of words given by their grams."""
    distinct, at = np.unique(code, return_inverse=True)
    p = np.full(len(distinct), 1 / 257)
    for k in range(1, order + 1):
        gram = distinct & np.uint64((1 << 8 * k) - 1)
        p = own.get(_gram_keys(lang, "share", k, gram), 0.0) + own.get(
            _gram_keys(lang, "context", k, gram >> np.uint64(8)), 1.0) * p
    return np.add.reduceat(np.log(p)[at], np.concatenate([[0], ends[:-1]]))


def word_table(words: DataFrame, model: Table, order: int, pool: bool, foreign: float) -> Table:
    """The log probability of every word of (lang, word)."""

    def keyed(batch: pa.RecordBatch):
        words = np.array(batch.column("word").to_pylist(), object)
        keys, values = np.empty(len(words), np.uint64), np.empty(len(words))
        for lang, own in _by_lang(batch):
            code, ends = grams(words[own].tolist(), order)
            v = _word_scores(reader(model), lang, code, ends, order)
            if pool:
                v = np.maximum(v, _word_scores(reader(model), POOL, code, ends, order) - foreign)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words[own]), np.uint64, len(own))
            keys[own], values[own] = mix(hashes ^ _seed(lang)), v
        return keys, values

    return saved(words.select("lang", "word"), keyed, part_bits(words.count()))


class Perplexity:
    """Log probabilities by a word table, of words that it was made of."""

    def __init__(self, table: Table):
        self.table = table

    def words(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The log probability of each word."""
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        values = reader(self.table).get(mix(keys ^ _seed(lang)), np.nan)
        if np.isnan(values).any():
            raise ValueError("a word that the table was not made of")
        return values

    def of(self, langs: list[str], lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes scored, and the negative log probability of a byte (nan without words), of each list of words."""
        sizes = np.array([sum(map(len, words)) + len(words) for words in lists], np.int64)
        total = np.array([self.words(lang, words).sum() for lang, words in zip(langs, lists)])
        return sizes, np.where(sizes > 0, -total / np.maximum(sizes, 1), np.nan)


def log_perplexities(blocks: DataFrame, table: Table) -> DataFrame:
    """(doc_id, lang, size, log_ppl, five measures) of every text of the bags.

    ``log_ppl`` is the negative log probability of a byte, null without words.
    """
    perplexity = Perplexity(table)

    def run(block: Block) -> pa.RecordBatch:
        values = pa.array(block.log_perplexities(perplexity), from_pandas=True)
        columns = [block.columns["doc_id"], pa.array([block.lang] * len(values), pa.string()), block.columns["size"], values]
        return pa.RecordBatch.from_arrays(
            columns + [block.columns[n] for n in NAMES], ["doc_id", "lang", "size", "log_ppl", *NAMES])

    return _over_blocks(
        blocks, run, "doc_id long, lang string, size long, log_ppl double" + "".join(f", {n} long" for n in NAMES))


def centres(rows: DataFrame, step: float = 1e-4) -> dict[str, tuple[float, float]]:
    """Median and scaled median absolute deviation of ``log_ppl`` for each language.

    From counts in bins of ``step``: at most some thousand rows a language reach the driver.
    """
    bins = rows.where("log_ppl is not null").groupBy("lang", F.round(F.col("log_ppl") / step).cast("long").alias("bin")).agg(
        F.count("*").alias("n")).orderBy("lang", "bin").toArrow()
    langs = np.array(bins["lang"].to_pylist(), object)
    out = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        at, n = bins["bin"].to_numpy()[own], bins["n"].to_numpy()[own]
        middle = at[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        away = np.abs(at - middle)
        order = np.argsort(away)
        spread = away[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        out[lang] = float(middle * step), float(max(spread, 1) * step * 1.4826)
    return out


def judge(docs: DataFrame, *, order: int = 5, rough_order: int = 3, trim: float = 1.0, foreign: float = 1.0, width: float = 12.0,
          below: float = 6.0, short: float = 300.0) -> DataFrame:
    """(doc_id, five measures, base_failed, log_ppl, low, high, kept) of every row."""
    blocks = staged(bags(_languages(docs)), "bags")
    words = staged(word_counts(blocks), "words")
    rough = word_table(words, fit(words, rough_order, False), rough_order, False, foreign)
    middle = centres(log_perplexities(blocks, rough))
    perplexity = Perplexity(rough)

    def ordinary(block: Block) -> np.ndarray:
        m, deviation = middle.get(block.lang, (0.0, 0.0))
        return np.abs(block.log_perplexities(perplexity) - m) <= trim * deviation

    table = word_table(words, fit(word_counts(blocks, ordinary), order, True), order, True, foreign)
    scored = staged(log_perplexities(blocks, table), "perplexities").withColumn("base_failed", _failed())
    bands = docs.sparkSession.createDataFrame(
        [(lang, m, d) for lang, (m, d) in centres(scored.where("not base_failed")).items()] or [("", 0.0, 0.0)],
        "lang string, middle double, deviation double").coalesce(1)
    unit = F.col("deviation") * F.sqrt(1 + F.lit(short) / F.greatest("size", F.lit(1)))
    return scored.join(bands, "lang", "left").select(
        "doc_id", *NAMES, "base_failed", "log_ppl",
        (F.col("middle") - unit * below).alias("low"), (F.col("middle") + unit * width).alias("high"),
    ).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False)))
