"""Zonal sums of past years, computed once for each coverage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafclock.operators.raster import zonal_means, zonal_sums
from leafclock.sources.versions import Batches

LAYOUT = ["coverage", "index", "year"]
SCHEMA = T.StructType([
    T.StructField("poly_id", T.StringType()), T.StructField("vw", T.DoubleType()), T.StructField("count", T.DoubleType()),
    T.StructField("coverage", T.StringType()), T.StructField("index", T.StringType()), T.StructField("year", T.IntegerType())])


def coverage_version(cov: DataFrame) -> str:
    """A name for the coverage's rows: another one if a region or the grid changes."""
    row = F.xxhash64("poly_id", "row", "col", F.round("frac", 9))
    found = cov.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"),
                    F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)).alias("y")).first()
    return f"v{found.n}-{found.x & (1 << 64) - 1:016x}{found.y & (1 << 64) - 1:016x}"


def _stored(batches: Batches) -> DataFrame:
    folders = [batches.folder(b) for b in batches.live()]
    if not folders:
        return batches.spark.createDataFrame([], SCHEMA)
    df = batches.spark.read.schema(SCHEMA).option("basePath", batches.path).parquet(*folders)
    return df.select(*SCHEMA.fieldNames())


def zonal_years(
    cells: DataFrame, cov: DataFrame, path: str, keys: Iterable[tuple[str, int]],
    fresh: Iterable[tuple[str, int]] = (),
) -> DataFrame:
    """``raster.zonal`` of the (index, year) in ``keys`` and ``fresh``, reading as few cells as can be.

    Sums of ``keys`` are kept under ``path``, by coverage, index and year: only those that are not there
    for this coverage are computed, as one batch that counts when it is complete. ``fresh`` ones, such as
    the current year, whose values still change, are computed every time and not kept. ``cells`` should be
    partitioned by index and year; without missing keys none but fresh partitions are opened.
    """
    batches = Batches(cells.sparkSession, path)
    version = coverage_version(cov)
    keys, fresh = sorted(set(keys) - set(fresh)), sorted(set(fresh))
    own = F.col("coverage") == version
    have = {(r["index"], r["year"]) for r in _stored(batches).where(own).select("index", "year").distinct().collect()}
    missing = [k for k in keys if k not in have]
    if missing:
        sums = zonal_sums(cells.where(_any(missing)), cov).withColumn("coverage", F.lit(version))
        sums.select(*SCHEMA.fieldNames()).hint("rebalance", *LAYOUT).write.partitionBy(*LAYOUT).parquet(
            batches.folder(uuid.uuid4().hex))
    wanted = _stored(batches).where(own & _any(keys)).drop("coverage")
    if fresh:
        wanted = wanted.unionByName(zonal_sums(cells.where(_any(fresh)), cov))
    return zonal_means(wanted)


def _any(keys):
    """A test on the partition columns, by index."""
    by: dict = {}
    for index, year in keys:
        by.setdefault(index, []).append(year)
    return reduce(or_, [(F.col("index") == i) & F.col("year").isin(*ys) for i, ys in by.items()], F.lit(False))
