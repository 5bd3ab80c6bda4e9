"""Keep the table of prior years up to date by adding only what is missing.

The cache is a folder of batches, each written once by one refresh and never
changed. A batch counts once its job has left the ``_SUCCESS`` mark, so a refresh
that dies half way leaves nothing behind that a reader would see, and the next run
computes the same rows again. As every refresh adds a batch, ``compact_cache`` merges
the short ones into one from time to time, while readers go on (``sources/versions.py``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafclock import schemas
from leafclock.operators.clean import clean_observations
from leafclock.operators.fill import fill_elevation, fill_state
from leafclock.params import Params
from leafclock.sources.scratch import staged
from leafclock.sources.versions import MERGED, Batches

LAYOUT = ["pheno_class_id", "year"]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All batches that count now; class and year are partition columns."""
    batches = Batches(spark, path)
    return _read(spark, path, [batches.folder(b) for b in batches.live()])


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schemas.PLANTS)
    df = spark.read.schema(schemas.PLANTS).option("basePath", path).parquet(*folders)
    return df.select(*schemas.PLANTS.fieldNames())


def _write(df: DataFrame, target: str) -> None:
    # Group rows by partition folder; AQE splits folders that hold many rows.
    df = df.hint("rebalance", *LAYOUT)
    df.write.mode("overwrite").partitionBy(*LAYOUT).parquet(target)


def compact_cache(
    spark: SparkSession, path: str, least: int = 4, full_bytes: int = 64 << 30
) -> DataFrame:
    """Merge the batches shorter than ``full_bytes`` into one, if there are ``least`` of them.

    Batches that have reached ``full_bytes`` are left alone, so a row is rewritten a few
    times at most, and a reader opens few folders however long refreshes go on. Batches that are
    added meanwhile stay as they are. If another compaction was first, its result stands and
    this one's folder is left to ``Batches.vacuum``.
    """
    batches = Batches(spark, path)
    base = batches.version()
    short = [b for b in batches.live(base) if batches.size(b) < full_bytes]
    if len(short) >= max(least, 2):
        merged = f"{MERGED}{uuid.uuid4().hex}"
        _write(_read(spark, path, [batches.folder(b) for b in short]), batches.folder(merged))
        batches.commit(base, {
            **{b: merged for b in short}, **{b: merged for b, into in base.replaced.items() if into in short}})
    return read_cache(spark, path)


def cache_state(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last cached year per class, and the species known per class."""
    last = cache.groupBy("pheno_class_id").agg(F.max("year").alias("last_year"))
    known = cache.select("pheno_class_id", "species_id").distinct()
    return last, known


def wanted(cache: DataFrame, cur: DataFrame, p: Params) -> DataFrame:
    """First year to fetch per class and species.

    Known species need the years after the last cached one; species seen this
    year and not cached need all prior years, also when nothing is cached yet.
    """
    last, known = cache_state(cache)
    classes = F.col("pheno_class_id").isin(*p.pheno_class_ids)
    newer = (
        known.join(last, "pheno_class_id")
        .where(classes & (F.col("last_year") < p.year - 1))
        .select("pheno_class_id", "species_id", (F.col("last_year") + 1).alias("from_year"))
    )
    absent = (
        cur.where(classes)
        .select("pheno_class_id", "species_id")
        .distinct()
        .join(known, ["pheno_class_id", "species_id"], "left_anti")
        .withColumn("from_year", F.lit(p.first_prior_year))
    )
    return newer.unionByName(absent)


def missing_rows(
    source: DataFrame, cache: DataFrame, cur: DataFrame, edges: DataFrame,
    site_elev: DataFrame, p: Params,
) -> DataFrame:
    """Cleaned and filled prior rows the cache lacks."""
    keys = ["pheno_class_id", "species_id"]
    raw = (
        source.where(F.col("first_yes_year").between(p.first_prior_year, p.year - 1))
        .where(F.col("pheno_class_id").isin(*p.pheno_class_ids))
        .join(staged(wanted(cache, cur, p), "wanted"), keys)
        .where(F.col("first_yes_year") >= F.col("from_year"))
        .drop("from_year")
    )
    clean = fill_state(staged(clean_observations(raw, p), "cleaned"), edges, p)
    return fill_elevation(clean, site_elev).select(*schemas.PLANTS.fieldNames())


def refresh_prior(
    spark: SparkSession, source: DataFrame, path: str, cur: DataFrame, edges: DataFrame,
    site_elev: DataFrame, p: Params, batch: str,
) -> DataFrame:
    """Add one batch of missing rows and return the whole cache.

    ``batch`` names the run; repeating a finished run's name changes nothing, and an
    unfinished one of that name is replaced.
    """
    batches = Batches(spark, path)
    if not batches.finished(batch):
        new = missing_rows(source, read_cache(spark, path), cur, edges, site_elev, p)
        _write(new, batches.folder(batch))
    return read_cache(spark, path)
