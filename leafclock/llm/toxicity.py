"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: single words, neighbouring words, and words with one word
between, hashed to ``2 ** bits`` coordinates. Words are runs of letters and digits, A-Z
lower-cased. FTRL keeps a learning rate for each coordinate, and its L1 term leaves most
weights at exactly zero, so the model is a short list of (coordinate, weight) pairs that
is broadcast: at most ``2 ** bits`` pairs of 12 bytes, in practice some thousands.

The fit uses at most ``max_rows`` labelled rows, chosen and ordered by hashes of their
ids, in one pass of one FTRL stream: online learning is sequential, and averaging several
streams made rare words too weak in trials. All tasks turn texts to coordinates; the stream
only updates, and holds one Arrow batch and its state (16 MB), never the sample.

Defined results: a null or empty text has no features and gets the intercept's score;
repeated rows get one score each; without labelled rows every score is 0.5. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.llm.common import (
    WordHashes, fold, fresh, labelled_sample, map_batches, mix, over_batches, pair, texts, with_column,
)

#: ASCII letters and digits, lower-cased, and all bytes of other characters; else a space.
_LETTERS = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)
_SKIP = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int


def features(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    """Coordinates of all n-grams and skip-grams of a text, in order, repeats included."""
    h = hashes.of(text.translate(_LETTERS).split())
    grams = [mix(h), pair(h[:-1], h[1:]), pair(h[:-2] ^ _SKIP, h[2:])]
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """State of one stream."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n ** 0.5) / self.alpha)

    def learn(self, i: np.ndarray, y: int) -> None:
        w, b = self.weights(i), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        n = self.n[i]
        grown = n + g * g
        self.z[i] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[i] = grown
        grown = self.bias_n + g * g
        self.bias_z += g - (grown ** 0.5 - self.bias_n ** 0.5) / self.alpha * b
        self.bias_n = grown


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, max_rows: int = 40_000,
        bits: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0) -> Model:
    """Weights from at most ``max_rows`` labelled rows outside fold 0 of 5."""
    rows = labelled_sample(docs, labels, label, max_rows)

    def coordinates(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(features(text, hashes, bits)).astype(np.int32).tobytes() for text in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())],
            ["draw", "doc_id", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Ftrl(bits, alpha, beta, l1, l2)
        for batch in batches:
            for at, y in zip(batch.column("at").to_pylist(), batch.column("y").to_pylist()):
                state.learn(np.frombuffer(at, np.int32), y)
        w = state.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], state.bias()))], ["i", "w"])

    hashes = WordHashes()
    stream = over_batches(rows, coordinates, "draw long, doc_id long, y int, at binary").repartition(1)
    stream = stream.sortWithinPartitions("draw", "doc_id", "at")
    got = map_batches(stream, learn, "i long, w double").toArrow()
    i, w = got["i"].to_numpy(), got["w"].to_numpy()
    return Model(i[i >= 0], w[i >= 0], float(w[i < 0].sum()), bits)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns and ``name``: between 0 and 1, higher for toxic text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    def run(batch: list[bytes]) -> np.ndarray:
        m = shared.value
        if not kept:
            dense = np.zeros(1 << m.bits)
            dense[m.index] = m.weight
            kept.update(dense=dense, hashes=WordHashes())
        dense, hashes = kept["dense"], kept["hashes"]
        out = []
        for text in batch:
            i = features(text, hashes, m.bits)
            i = i[dense[i] != 0]
            out.append(dense[np.unique(i)].sum() + m.bias)
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))

    return with_column(docs, name, "double", run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from ``threshold`` on."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, all columns."""
    name = fresh(docs, "_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
