"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other. That is so
exactly if their common prefix and common suffix together reach the longer length less one. Words lie as rows of
a matrix of code points, padded with zeros, once flush left and once flush right; a tile compares a block of rows
with another block at once: the first unequal column from the left is the common prefix, from the right the common suffix.

Only words that can be near need to meet. The shorter word of a pair is cut into ``2 ** depth`` segments by
its length; the edit lies in one of them, so all that stands before and after that segment is equal. A
word therefore goes to one cell (length, segment, what is outside) for each segment, once as the
shorter and once as the longer word. A pair counts in the cell of the segment that holds the end of its
common prefix, and so counts once. A cell with more than ``crowd`` words is refined: its
words go to the cells of twice as many segments instead, until segments have one code point
and all words of a cell are near one another. So nothing is capped, and a
frequent beginning or ending makes no large task. Cells are dealt by their hash, sorted, and
packed into blocks of rows; a cell that is longer than a block meets itself block by block.

Tiles give, for each of their words, the number of near words and the best of them. Pairs are never
rows. Chains of forms are followed by doubling.

Defined results: null texts have no runs; repeated rows count again; a word without near words has n_near
0 and is its own root. Texts of any length are cut by Spark. Other columns are ignored. An empty table has
no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafclock.llm.common import map_batches, slices
from leafclock.sources.scratch import staged

#: What words are made of: ASCII letters and U+00C0 to U+00FF.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """(doc_id, run) of every maximal run of letters with ``shortest`` or more, A-Z lower-cased.

    A greedy match of that many letters or more takes a run as a whole.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"([{LETTERS}]{{{shortest},}})"))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(every: int = 199) -> Column:
    """The run, without one code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    left, right = F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run"))
    return F.when(h % every == 0, F.concat(left, right)).otherwise(F.col("run"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of words of at least ``shortest`` code points that occur ``least`` times."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least)


def cuts(length: int, depth: int) -> list[int]:
    """Where a word of that length is cut into segments: their starts, and the end."""
    parts = min(1 << depth, max(1, length))
    return [length * i // parts for i in range(parts + 1)]


def cells(word: str, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, base, low, high) of the cells of a word; base is the length of the shorter word."""
    data, n = word, len(word)
    for base in (n, n - 1):
        if base < 1:
            continue
        bounds = cuts(base, depth)
        for low, high in zip(bounds, bounds[1:]):
            outside = f"{base},{low},{high},{data[:low]},{data[high + n - base:]}"
            yield xxhash.xxh3_64_intdigest(outside) - (1 << 63), base, low, high


def _dealt(words: DataFrame, depth: int, within: bool = False) -> DataFrame:
    """(cell, base, low, high, word, n) of all words; ``within`` their present cells, only what lies in those."""
    schema = "cell long, base int, low int, high int, word string, n long"
    names = ["cell", "base", "low", "high", "word", "n"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 18):
            got = part.to_pydict()
            limits = zip(got["base"], got["low"], got["high"]) if within else [None] * part.num_rows
            out = [
                (*c, word, n) for word, n, limit in zip(got["word"], got["n"], limits) for c in cells(word, depth)
                if limit is None or (c[1] == limit[0] and limit[1] <= c[2] and c[3] <= limit[2])]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return map_batches(words, run, schema)


def tiled(words: DataFrame, depth: int = 1, crowd: int = 256) -> DataFrame:
    """All words in cells of at most ``crowd`` words, or of a single segment of one code point."""
    done, left = None, _dealt(words.select("word", "n"), depth)
    while True:
        left = staged(left, "cells")
        large = staged(left.where("high - low > 1").groupBy("cell").count().where(F.col("count") > crowd).select("cell"), "crowded")
        fit = left.join(large, "cell", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if large.isEmpty():
            return done
        depth += 1
        left = _dealt(left.join(large, "cell", "left_semi"), depth, within=True)


class Matrix:
    """Words as padded code points, flush left and flush right."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = int(self.length.max(initial=0))
        ends = np.cumsum(self.length)
        column = np.arange(len(points)) - np.repeat(ends - self.length, self.length)
        row = np.repeat(np.arange(len(words)), self.length)
        self.left = np.zeros((len(words), width), np.uint32)
        self.left[row, column] = points
        self.right = np.zeros((len(words), width), np.uint32)
        self.right[row, np.repeat(self.length, self.length) - 1 - column] = points

    def common(self, a: slice, b: slice, flush: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings (endings, flush right) of two blocks of words."""
        differs = flush[a, None, :] != flush[None, b, :]
        first = differs.argmax(axis=2)
        same = ~np.take_along_axis(differs, first[:, :, None], 2)[:, :, 0]
        first[same] = flush.shape[1]
        return np.minimum(first, np.minimum(self.length[a, None], self.length[None, b]))


def near(m: Matrix, a: slice, b: slice, cell: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which pairs of two blocks of rows are near and counted in their common cell."""
    prefix, suffix = m.common(a, b, m.left), m.common(a, b, m.right)
    longer = np.maximum(m.length[a, None], m.length[None, b])
    shorter = np.minimum(m.length[a, None], m.length[None, b])
    segment = (prefix >= low[a, None]) & ((prefix < high[a, None]) | ((high == base)[a, None] & (prefix == base[a, None])))
    return ((cell[a, None] == cell[None, b]) & (base[a, None] == base[None, b]) & (low[a, None] == low[None, b])
            & (shorter == base[a, None]) & (prefix + suffix >= longer - 1) & (prefix < longer) & segment)


def compared(batch: pa.RecordBatch, cells_of_tile: int = 1 << 21) -> list[tuple[str, int, int, str]]:
    """(word, near words, n of the best, best) of rows that are sorted by cell, tile by tile."""
    words = batch.column("word").to_pylist()
    cell, base, low, high, n = (batch.column(c).to_numpy() for c in ("cell", "base", "low", "high", "n"))
    m = Matrix(words)
    order = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"))
    size = max(1, min(128, isqrt(cells_of_tile // max(1, m.left.shape[1]))))
    starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1])]))
    last = np.repeat(np.concatenate([starts[1:], [len(cell)]]), np.diff(np.append(starts, len(cell))))
    out = []
    for i in range(0, len(words), size):
        a = slice(i, min(i + size, len(words)))
        for j in range(i, int(last[a.stop - 1]), size):
            b = slice(j, min(j + size, len(words)))
            pairs = near(m, a, b, cell, base, low, high)
            for x, y, hit in ((a, b, pairs), (b, a, pairs.T))[:1 + (i != j)]:
                ranking = np.lexsort((order[y], -n[y]))  # the largest n first, then the least code points
                best = ranking[hit[:, ranking].argmax(axis=1)] + y.start
                out += [(words[x.start + row], int(hit[row].sum()), int(n[best[row]]), words[best[row]])
                        for row in np.flatnonzero(hit.any(axis=1))]
    return out


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def links(words: DataFrame, crowd: int = 256, rows: int = 20_000) -> DataFrame:
    """(word, n_near, form, form_n) of words with near words; the form is that of largest n, then of least code points."""
    placed = tiled(words, crowd=crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches, rows):
            found = compared(batch)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    placed = placed.repartition("cell").sortWithinPartitions("cell")
    found = map_batches(placed, run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("at")).select(
        "word", "n_near", F.col("at.best").alias("form"), (-F.col("at.m")).alias("form_n"))


def _whole_cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that no cell is split between; single words of a cell are left out."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cell = whole.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield from _pairable(whole.slice(0, cut))
        held, n = [whole.slice(cut)], len(cell) - cut
    if n:
        yield from _pairable(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _pairable(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    cell = batch.column("cell").to_numpy()
    alone = np.concatenate([[True], cell[1:] != cell[:-1]]) & np.concatenate([cell[1:] != cell[:-1], [True]])
    if not alone.all():
        yield batch.filter(pa.array(~alone))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): the form at the end of its chain."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("key"), F.col("root").alias("next"))
        step = at.join(ahead, F.col("root") == F.col("key"), "left")
        after = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 5, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    The form is the near word of largest n (ties: smallest), if that is at least ``ratio``
    times the word's own.
    """
    words = staged(words, "vocabulary")
    found = words.join(links(words, **how), "word", "left")
    much = F.col("form_n") >= ratio * F.col("n")
    found = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(much, F.col("form")).alias("form"), F.when(much, F.col("form_n")).alias("form_n")), "forms")
    roots = rooted(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """Groups the words of all documents, some of them misspelt; shorter runs cannot become words."""
    words = runs(docs, shortest).select(misspelt(every).alias("word"))
    return group_variants(vocabulary(words, shortest, least))
