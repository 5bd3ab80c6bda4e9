"""Approximate nearest neighbours by cross-polytope hashing with several probes.

A vector is scaled to length 1, padded to a power of two and rotated by three rounds of
random signs and fast Hadamard transforms; its hash is the axis, with its sign, that it
comes nearest to. ``axes`` such hashes together are a bucket of one table (one by default:
2 * dimension buckets). Every vector is put in one bucket of each of ``tables`` tables. A query
looks in the ``probes`` buckets of each table whose axes it comes nearest to, measures all
vectors there exactly, and keeps the ``k`` nearest.

Vectors meet queries by table and bucket. A bucket with very many vectors or queries is
dealt in blocks of about ``block`` of each, every block returns at most ``k`` rows for a query,
so no bucket is ever whole in one task and no pairs are written. Queries that find fewer than
``k`` get all vectors, in the same blocks.

Recall depends on the data: with 10 tables of 20 probes it is about 0.99 on vectors in 64
dimensions without any clusters, where about 0.7 of the vectors are candidates; clustered
data need far fewer. ``recall`` measures it against brute force.

Defined results: null ids and vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different lengths do not meet; rows with the same id
are never each other's neighbours, and such an id is listed once, at its nearest. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafclock.llm.common import map_batches, over_batches
from leafclock.sources.scratch import staged


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of rows: three rounds of signs and Hadamard transforms."""
    signs = np.random.default_rng(seed).integers(0, 2, (3, x.shape[1])) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small vectors stay finite
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    width = 1 << (x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def codes(x: np.ndarray, tables: int, axes: int, probes: int) -> np.ndarray:
    """(row, table, probe): buckets in the order of how near their axes are; the first is the vector's own."""
    unit = _padded(x)
    width = 2 * unit.shape[1]
    probes = min(probes, width ** axes)
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        best = code = None
        for a in range(axes):
            y = rotate(unit, 1 + t * axes + a)
            score = np.concatenate([y, -y], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            near = np.take_along_axis(score, top, axis=1)
            if best is None:
                best, code = near, top
                continue
            both = (best[:, :, None] + near[:, None, :]).reshape(len(x), -1)
            pairs = (code[:, :, None] * width + top[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            best, code = np.take_along_axis(both, pick, axis=1), np.take_along_axis(pairs, pick, axis=1)
        out[:, t, :code.shape[1]] = code
    return out


def _hashed(rows: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """(vec_id, dim, vec, codes) of the valid rows; ``codes`` holds table by table ``probes`` buckets."""
    single = isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, found = batch.column("vec_id").to_numpy(zero_copy_only=False), {}
        for i, v in zip(ids, batch.column("embedding")):
            v = v.values
            if v is None or not len(v) or v.null_count:
                continue
            v = v.to_numpy(zero_copy_only=False)
            if np.isfinite(v).all() and v.any():
                found.setdefault(len(v), []).append((i, v))
        parts = []
        for dim, own in found.items():
            x = np.array([v for _, v in own], np.float64)
            c = codes(x, tables, axes, probes).reshape(len(x), -1)
            parts.append(pa.RecordBatch.from_arrays([
                pa.array([int(i) for i, _ in own], pa.int64()), pa.array(np.full(len(own), dim), pa.int32()),
                pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                pa.array(list(c), pa.list_(pa.int64()))], ["vec_id", "dim", "vec", "codes"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    cast = F.col("embedding").cast("array<float>" if single else "array<double>")
    return over_batches(rows.where("vec_id is not null").select("vec_id", cast.alias("embedding")), run,
                        "vec_id long, dim int, vec binary, codes array<long>")


def _nearest(asking: DataFrame, points: DataFrame, k: int, block: int, kind: np.dtype) -> DataFrame:
    """(query_id, vec_id, score): at most ``k`` rows for each query and block of a bucket.

    Both sides are (bucket columns, vec_id, vec).
    """
    keys = ["dim", "table", "code"]
    size = points.groupBy(keys).agg(F.count("*").alias("points")).join(
        asking.groupBy(keys).agg(F.count("*").alias("asks")), keys)
    size = size.select(*keys, *(F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("points", "asks")))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(rows: DataFrame, part: Column, ask: Column, first: int) -> DataFrame:
        return rows.join(size, keys).select(*keys, part.alias("part"), ask.alias("ask"), F.lit(first).alias("kind"), "vec_id", "vec")

    both = dealt(asking, every("points"), own("asks"), 0).union(dealt(points, own("points"), every("asks"), 1))
    group = [*keys, "part", "ask"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, *group).sortWithinPartitions(*group, "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, best = None, [], []

        def results():
            rows = [(q, int(i), float(d)) for (q, _), (ids, ds) in zip(queries, best) for i, d in zip(ids, ds)]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*group, "kind")]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                key = tuple(c[s] for c in columns[:-1])
                if key != at:
                    if queries:
                        yield results()
                    at, queries, best = key, [], []
                ids = batch.column("vec_id").slice(s, e - s).to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(batch.column("vec").slice(s, e - s).to_pylist()), kind).reshape(e - s, -1).astype(np.float64)
                if columns[-1][s] == 0:
                    queries += [(int(i), v) for i, v in zip(ids, x)]
                    best += [(np.zeros(0, np.int64), np.zeros(0))] * (e - s)
                    continue
                for j, (q, v) in enumerate(queries):
                    d = x - v
                    d = np.sqrt(np.einsum("ij,ij->i", d, d))
                    i, d = np.concatenate([best[j][0], ids[ids != q]]), np.concatenate([best[j][1], d[ids != q]])
                    if len(d) > k:  # all that tie with the k-th, then the smaller ids
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        i, d = i[near], d[near]
                    order = np.lexsort((i, d))
                    # An id that occurs twice counts once, at its nearest.
                    order = order[np.sort(np.unique(i[order], return_index=True)[1])][:k]
                    best[j] = i[order], d[order]
        if queries:
            yield results()

    return map_batches(both, run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column | str, *, k: int = 10, tables: int = 10, probes: int = 20, axes: int = 1,
           block: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for the rows where ``queries`` is true."""
    kind = np.dtype(np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64)
    points = staged(_hashed(vectors, tables, axes, 1), "points")
    asking = staged(_hashed(vectors.where(queries), tables, axes, probes), "queries")
    per = F.floor(F.col("pos") * tables / F.size("codes")).cast("int").alias("table")
    spread = lambda rows: rows.select("vec_id", "dim", "vec", "codes", F.posexplode("codes").alias("pos", "code")).select(
        "dim", per, "code", "vec_id", "vec")
    found = staged(_ranked(_nearest(spread(asking), spread(points), k, block, kind), k), "found")

    few = asking.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    whole = lambda rows: rows.select("dim", F.lit(0).alias("table"), F.lit(0).cast("long").alias("code"), "vec_id", "vec")
    few = staged(whole(few), "few")
    if few.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    again = _ranked(_nearest(few, whole(points), k, block, kind), k)
    enough = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return enough.unionByName(again).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, queries: Column | str, *, k: int = 10, block: int = 2_048, **how) -> float:
    """Share of the true ``k`` nearest that ``search`` finds, against all vectors."""
    kind = np.dtype(np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64)
    rows = lambda v: _hashed(v, 1, 1, 1).select(
        "dim", F.lit(0).alias("table"), F.lit(0).cast("long").alias("code"), "vec_id", "vec")
    truth = _ranked(_nearest(rows(vectors.where(queries)), rows(vectors), k, block, kind), k)
    got = search(vectors, queries, k=k, block=block, **how)
    both = truth.select("query_id", "vec_id").join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0))).first()[0]
