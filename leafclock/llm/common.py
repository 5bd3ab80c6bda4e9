"""What several of the operators share: folds, labelled samples, words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of other characters than these: what ``bytes.split`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y, draw) of at most ``max_rows`` labelled documents outside fold 0 of 5.

    The rows are those with the smallest hashes of their ids, so reruns agree. The
    sample is bounded: its ids (28 bytes a row) are broadcast up to a million rows, so that
    no text is shuffled; a larger sample is joined as Spark finds best. An id that is
    labelled twice counts as 1 if any of its labels is 1.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("draw", F.xxhash64("doc_id", F.lit(17)))
        .orderBy("draw", "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen) if max_rows <= 1_000_000 else chosen, "doc_id")


def map_batches(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of about 2 MB, whose workers give memory back after a task.

    Spark's own limit is a number of rows, which for long texts makes batches that fill
    the memory beside the heap: the executor holds several copies of each task's batch there.
    The limit in bytes is a setting of the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hands memory that is free in this process back to the system.

    Workers wait for further tasks; what their last one needed would stay beside the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType,
                 slice_bytes: int = 8 << 20, gather: int = 0) -> DataFrame:
    """``fn`` over the rows in Arrow batches of about ``slice_bytes``; ``schema`` names what it returns.

    Of short rows, ``gather`` can ask for more than Spark's own batches hold.

    A batch that is larger is handed over in slices, so a worker's memory follows the
    slice, or the longest row where that is more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(gathered(batches, gather) if gather else batches, slice_bytes):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return map_batches(df, run, schema)


def slices(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_column(df: DataFrame, name: str, kind: str, fn: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """All columns and ``name``, what ``fn`` makes of the texts; one of that name is replaced."""
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(fn(texts(batch)))], [*batch.schema.names, name])

    return over_batches(df, run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, also those whose names hold a dot."""
    return [F.col(f"`{c}`") for c in df.columns]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Short batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately in this worker."""

    def __init__(self, keep: int = 200_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    a = a ^ (a >> np.uint64(32))
    a = a * _MIX2
    a = a ^ (a >> np.uint64(32))
    a = a * _MIX2
    return a ^ (a >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    return mix(a * _MIX + (b ^ (b >> np.uint64(29))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
