"""URL filters: rules first, then a likelihood ratio of two character models.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path
starts with its own, and the longest fitting rule decides. The other urls are judged by two
variable-order Markov models over characters (bytes), one of the urls that rules allow and
one of those that they block. A character's probability after the longest context is
mixed with those after shorter ones by Witten-Bell smoothing, so an unseen context passes
its whole weight down. The verdict is taken from the difference of the log likelihoods per
character, calibrated by a logistic regression, with both classes weighing the same, on a
fifth of the ruled urls that the models do not see.

Contexts and their continuations are counted exactly: a code holds the characters
themselves, and its scrambled form is one to one. The counts are sorted arrays in the shared
folder, as many as there are different ones, which workers map; nothing is broadcast.

Defined results: a url that is null or without ``://`` has an empty host and path and fits
no rule; an empty text after ``://`` has difference 0; where all ruled urls
have one verdict there is nothing to compare with and the others get it too; without any
ruled url all are allowed. Repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafclock.llm.arrays import by_part
from leafclock.llm.common import fold, mix, over_batches, texts
from leafclock.llm.tables import Table, part_bits, reader, saved
from leafclock.sources.scratch import staged

#: Characters of context at most.
ORDER = 5
_PAD = 1
#: Codes that keep every bit: exact counts.
_BITS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, name: str) -> Rule:
    """A rule from its verdict and a name like ``example.net/en/``."""
    host, slash, path = name.partition("/")
    return Rule(verdict, host, slash + path)


def rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; empty where there is none."""
    r = F.coalesce(rest(url), F.lit(""))
    host = F.regexp_extract(r, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(r, F.length(host) + 1, F.length(r)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def decide(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null; of equals the longer host, then name."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def cells(batch: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of grams and of their contexts, a row for each order from 0 to ORDER, and the texts' lengths.

    With 64 bits no two grams, and no two contexts, share one.
    """
    pad = bytes([_PAD]) * ORDER
    data = np.frombuffer(b"".join(pad + t for t in batch), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in batch], np.int64)
    starts = np.cumsum(lengths + ORDER) - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    grams, contexts = [], []
    context = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = (context << np.uint64(8)) | data[at - k]
        tag = np.uint64(k << 56)
        contexts.append((mix(context | tag) >> np.uint64(64 - bits)).astype(np.int64))
        grams.append((mix((context << np.uint64(8)) | data[at] | tag) >> np.uint64(64 - bits)).astype(np.int64))
    return np.array(grams), np.array(contexts), lengths


@dataclass(frozen=True)
class Model:
    counts: Table | None
    weights: tuple[float, float]
    default: str


#: What is counted for each class.
_KINDS = ("gram", "context", "continuations")


def _keys(code: np.ndarray, y: int, kind: str) -> np.ndarray:
    """One to one for a class and kind."""
    return mix(code.view(np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(f"{y} {kind}".encode())))


@dataclass(frozen=True)
class _Counts:
    """Saved counts of a class and kind, read by code as an array would be."""

    table: Table
    y: int
    kind: str

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(code, return_inverse=True)
        return reader(self.table).get(_keys(distinct, self.y, self.kind), 0.0)[at]


def _tables(counts: Table) -> list[list[_Counts]]:
    """Allowed first."""
    return [[_Counts(counts, y, kind) for kind in _KINDS] for y in (1, 0)]


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.translate(
        F.coalesce(rest(F.col("url")), F.lit("")), string.ascii_uppercase, string.ascii_lowercase))


def differences(batch: list[bytes], tables, bits: int) -> np.ndarray:
    """Log likelihood of allowed minus that of blocked text, per character; 0 for an empty text.

    ``tables`` gives gram counts, context counts and continuations of either class by cell.
    """
    grams, contexts, lengths = cells(batch, bits)
    logs = []
    for table in tables:
        p = np.full(grams.shape[1], 1 / 256)
        for g, c in zip(grams, contexts):
            total, kinds = table[1][c], table[2][c]
            seen = total > 0
            p = np.where(seen, (np.minimum(table[0][g], total) + kinds * p) / np.maximum(total + kinds, 1), p)
        logs.append(np.log(p))
    ends = np.cumsum(np.concatenate([[0.0], logs[0] - logs[1]]))
    upto = np.cumsum(lengths)
    return (ends[upto] - ends[upto - lengths]) / np.maximum(lengths, 1)


def fit(ruled: DataFrame) -> Model:
    """The models of rows (page_id, text, verdict) with verdict allow or block."""
    rows = ruled.withColumn("y", (F.col("verdict") == "allow").cast("int")).withColumn("part", fold("page_id", 5))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t, ys = texts(batch), batch.column("y").to_numpy(zero_copy_only=False)
        out = []
        for y in (0, 1):
            own = [x for x, k in zip(t, ys) if k == y]
            if own:
                grams, contexts, _ = cells(own, _BITS)
                codes, first, n = np.unique(grams.ravel(), return_index=True, return_counts=True)
                out.append((np.full(len(codes), y), codes, contexts.ravel()[first], n))
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in zip(*out)], ["y", "gram", "context", "n"])

    counts = over_batches(rows.where("part > 0").select("text", "y"), count, "y long, gram long, context long, n long")
    counts = staged(counts.groupBy("y", "gram", "context").agg(F.sum("n").alias("n")), "grams")
    contexts = staged(counts.groupBy("y", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "contexts")
    entries = counts.select("y", F.lit(0).alias("kind"), F.col("gram").alias("code"), "n").union(
        contexts.select("y", F.lit(1), "context", "n")).union(contexts.select("y", F.lit(2), "context", "kinds"))

    def keyed(batch: pa.RecordBatch):
        y, kind, code = (batch.column(c).to_numpy() for c in ("y", "kind", "code"))
        keys = np.empty(len(code), np.uint64)
        for which, i in by_part(3 * y + kind):
            keys[i] = _keys(code[i], which // 3, _KINDS[which % 3])
        return keys, batch.column("n").to_numpy()

    classes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(classes) < 2:
        return Model(None, (1.0, 0.0), "block" if classes and 0 in classes else "allow")
    table = saved(entries, keyed, part_bits(entries.count()), kind="float64")
    held = rows.where("part = 0")
    if held.groupBy("y").count().count() < 2:
        held = rows  # too few urls to set any aside

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = differences(texts(batch), _tables(table), _BITS)
        return pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array(np.round(np.clip(d, -10, 10) * 1000).astype(np.int64))], ["y", "bin"])

    # Bins of a thousandth between -10 and 10: bounded.
    got = over_batches(held.select("text", "y"), measure, "y int, bin long").groupBy("y", "bin").count().orderBy("y", "bin").collect()
    y, x, n = (np.array([r[k] for r in got], float) for k in range(3))
    n = n / np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    return Model(table, _calibrated(x / 1000, y, n), "allow")


def _calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, r = n * p * (1 - p), n * (y - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, np.array([(r * x).sum() - ridge * a, r.sum() - ridge * b]))
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference, probability) of every row.

    ``probability`` is that of being allowed, null where a rule decided.
    """
    host, path = host_and_path(F.col("url"))
    rows = _text(pages.select("page_id", "url")).select("page_id", "text", host.alias("host"), path.alias("path"))
    name, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)
    model = fit(rows.where("verdict is not null").select("page_id", "text", "verdict"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts(batch)
        d = differences(t, _tables(model.counts), _BITS) if model.counts is not None else np.zeros(len(t))
        keep = [batch.column(c) for c in ("page_id", "host", "path", "rule", "verdict")]
        return pa.RecordBatch.from_arrays(
            [*keep, pa.array(d)], ["page_id", "host", "path", "rule", "verdict", "difference"])

    scored = over_batches(rows, run, "page_id long, host string, path string, rule string, verdict string, difference double")
    a, b = model.weights
    chance = 1 / (1 + F.exp(-(F.col("difference") * a + b)))
    own = F.when(chance >= 0.5, "allow").otherwise("block") if model.counts is not None else F.lit(model.default)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "difference",
        F.when(F.col("verdict").isNull(), chance).alias("probability"))
