"""Text quality by compression with zstandard dictionaries of good and bad text.

Text that resembles what a dictionary was built from compresses better with it. Whole
texts are cut into pieces of ``piece`` bytes so that a long text cannot teach the
compressor itself; every piece is compressed with both dictionaries. The sizes give two
features: the difference (bad - good) over the smaller size, and the log of the smaller
size over the length (text that repeats itself is tiny either way). A logistic regression
on labelled rows outside the dictionaries turns them into a probability.

The fit uses at most ``max_rows`` labelled rows and ``max_pieces`` pieces of each class,
so the model is two dictionaries of ``dict_bytes`` and three weights, whatever the input.

Defined results: a null text counts as empty; an empty text has no features and gets the
calibrated score of features 0; repeated rows get one score each; without labelled rows of both
classes every score is the share of label 1 (0.5 with none). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.llm.common import fold, fresh, labelled_sample, logistic, over_batches, texts, with_column
from leafclock.sources.scratch import staged

#: Bytes added to sizes, so that very short texts stay near the middle.
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    share: float
    piece: int
    level: int


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on
        return b"".join(pieces)[-size:]


def _smallest(pieces: DataFrame, wanted: int, total: int) -> list[bytes]:
    """The ``wanted`` pieces of smallest draws, of about ``total``.

    Draws spread evenly over 64 bits, so a bound on them holds back nearly all other pieces
    before the tasks send theirs; where it leaves too few (ids that repeat), it is lifted.
    """

    def take(some: DataFrame) -> list[bytes]:
        return [bytes(r.piece) for r in some.orderBy("draw", "piece").limit(wanted).collect()]

    share = 2 * wanted / total if total else 1.0
    if share < 1:
        found = take(pieces.where(F.col("draw") < int(2 ** 64 * share) - 2 ** 63))
        if len(found) == wanted:
            return found
    return take(pieces)


class _Sizes:
    """Compressed sizes of whole texts with both dictionaries."""

    def __init__(self, model: Model):
        self.piece = model.piece
        self.compressors = []
        for data in (model.bad, model.good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=d, level=model.level, write_checksum=False,
                write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        cuts = range(0, len(text), self.piece)
        bad, good = (sum(len(c.compress(text[i:i + self.piece])) for i in cuts) for c in self.compressors)
        least = min(bad, good)
        return (bad - good) / (least + SMOOTH), float(np.log((least + SMOOTH) / (len(text) + 2 * SMOOTH)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, max_rows: int = 20_000,
        max_pieces: int = 3_000, dict_bytes: int = 32_768, piece: int = 2_048, level: int = 3) -> Model:
    """Dictionaries and calibration from labelled rows outside fold 0 of 5.

    A third of the sample's rows calibrate, the others give pieces to the dictionaries
    (those with the smallest hashes, of every part of every text). The sample is written once
    and read four times.
    """
    rows = staged(labelled_sample(docs, labels, label, max_rows), "labelled")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pieces, ys, draws = [], [], []
        for text, y, draw in zip(texts(batch), batch.column("y").to_pylist(), batch.column("draw").to_pylist()):
            starts = range(0, len(text), piece)
            pieces += [text[i:i + piece] for i in starts]
            ys += [y] * len(starts)
            draws += [hash((draw, i)) for i in starts]
        return pa.RecordBatch.from_arrays(
            [pa.array(ys, pa.int32()), pa.array(draws, pa.int64()), pa.array(pieces, pa.binary())],
            ["y", "draw", "piece"])

    pieces = over_batches(rows.where("part <> 0"), cut, "y int, draw long, piece binary")
    taught = F.when(F.col("part") != 0, F.ceil(F.octet_length("text") / piece))
    n = {r.y: r for r in rows.groupBy("y").agg(F.count("*").alias("rows"), F.sum(taught).alias("pieces")).collect()}
    share = n[1].rows / sum(r.rows for r in n.values()) if 1 in n else 0.0 if n else 0.5
    got = {y: _smallest(pieces.where(F.col("y") == y), max_pieces, (n[y].pieces or 0) if y in n else 0) for y in (0, 1)}
    model = Model(b"", b"", (), share, piece, level)
    if not (got[0] and got[1]):
        return model
    model = Model(_dictionary(got[1], dict_bytes), _dictionary(got[0], dict_bytes), (), share, piece, level)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = np.array([sizes.features(t) for t in texts(batch)]).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column("y")], ["d", "r", "y"])

    sizes = _Lazy(model)
    cal = over_batches(rows.where("part = 0"), measure, "d double, r double, y int").collect()
    cal.sort()
    y = np.array([r.y for r in cal], float)
    if len(set(y)) < 2:
        return model
    w = logistic(np.array([[r.d, r.r] for r in cal]), y)
    return Model(model.good, model.bad, tuple(w), share, piece, level)


class _Lazy:
    """Builds the compressors in the worker that uses them."""

    def __init__(self, model: Model):
        self.model, self.sizes = model, None

    def __getstate__(self):
        return self.model

    def __setstate__(self, model):
        self.model, self.sizes = model, None

    def features(self, text: bytes) -> tuple[float, float]:
        if self.sizes is None:
            self.sizes = _Sizes(self.model)
        return self.sizes.features(text)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns and ``name``: between 0 and 1, higher for good text."""
    sizes, w = _Lazy(model), model.weights

    def run(batch: list[bytes]) -> np.ndarray:
        if not w:
            return np.full(len(batch), model.share)
        f = np.array([sizes.features(t) for t in batch]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(f @ np.array(w[:-1]) + w[-1], -500, 500)))

    return with_column(docs, name, "double", run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from ``threshold`` on."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns."""
    name = fresh(docs, "_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
