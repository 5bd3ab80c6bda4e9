"""Observation and dimension tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from calendar import isleap
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafclock import schemas


def read_observations(spark: SparkSession, path: str, kind: str = "plants") -> DataFrame:
    """Cleaned observations from CSV, ``NA`` as missing, with a fixed schema."""
    return (
        spark.read.schema(schemas.OBSERVATIONS[kind])
        .option("nullValue", "NA")
        .csv(path, header=True)
    )


def read_prior(spark: SparkSession, path: str, classes) -> DataFrame:
    """Prior years of the given classes from one table partitioned by class.

    The class test is on the partition column, so other classes are never listed.
    """
    df = spark.read.schema(schemas.PLANTS).parquet(path)
    return df.where(F.col("pheno_class_id").isin(*classes))


def scan_observations(
    df: DataFrame,
    years=None,
    classes=None,
    phenophases=None,
    species=None,
    taxon_classes=None,
) -> DataFrame:
    """Raw rows by year, class, phenophase, species and taxon class.

    Each given list becomes an ``IN`` test on a plain column, which Spark pushes
    into the scan. The conflict flag is cast to text so that sources stack.
    """
    tests = {
        "first_yes_year": years,
        "pheno_class_id": classes,
        "phenophase_id": phenophases,
        "species_id": species,
        "class_id": taxon_classes,
    }
    for column, values in tests.items():
        if values is not None:
            df = df.where(F.col(column).isin(*values))
    if "observed_status_conflict_flag" in df.columns:
        flag = F.col("observed_status_conflict_flag").cast("string")
        df = df.withColumn("observed_status_conflict_flag", flag)
    return df


def _period_days(start_mmdd: str, end_mmdd: str, leap: bool) -> list[tuple[int, int]]:
    """First and last day of year of a calendar period: one range, or two if it turns over new year."""
    first = date(2024 if leap else 2023, 1, 1)
    days = [(first + timedelta(days=i)).strftime("%m-%d") for i in range(366 if leap else 365)]
    start, end = bisect_left(days, start_mmdd) + 1, bisect_right(days, end_mmdd)
    whole = [(start, end)] if start_mmdd <= end_mmdd else [(1, end), (start, len(days))]
    return [(a, b) for a, b in whole if a <= b]


def in_period(
    df: DataFrame,
    start_mmdd: str,
    end_mmdd: str,
    year: str = "first_yes_year",
    doy: str = "first_yes_doy",
    years=None,
) -> DataFrame:
    """Rows whose day falls in a calendar period of its own year, which may turn over new year.

    The period is a range of days of common years and one of leap years, a day apart after
    February. The days of either kind are plain comparisons, which Spark pushes into the scan; with
    ``years`` given, so is the choice between them, as lists of years.
    """
    day = F.col(doy)

    def within(leap):
        ranges = [day.between(a, b) for a, b in _period_days(start_mmdd, end_mmdd, leap)]
        return reduce(or_, ranges, F.lit(False))

    either = F.lit(False)
    if years is not None:
        for leap in (True, False):
            own = [y for y in years if isleap(y) == leap]
            either = either | (F.col(year).isin(*own) & within(leap)) if own else either
        return df.where(either)
    common, leap = (_period_days(start_mmdd, end_mmdd, kind) for kind in (False, True))
    # What either kind of year allows reaches the scan; the exact test is left to the rows it returns.
    loose = reduce(or_, [day.between(min(a, c), max(b, d)) for (a, b), (c, d) in zip(common, leap)], F.lit(False))
    if len(common) != len(leap):
        loose = within(True) | within(False)
    y = F.col(year)
    is_leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return df.where(loose).where((is_leap & within(True)) | (~is_leap & within(False)))


def from_day(df: DataFrame, first_doy: int = 180, doy: str = "first_yes_doy") -> DataFrame:
    return df.where(F.col(doy) >= first_doy)


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    known = {
        "phase_classes": schemas.PHASE_CLASSES,
        "phenophases": schemas.PHENOPHASES,
        "species": schemas.SPECIES,
        "layers": schemas.LAYERS,
    }
    return spark.read.schema(known[name]).option("nullValue", "NA").csv(path, header=True)


def phenophases_of(phenophases: DataFrame, category: str) -> DataFrame:
    return phenophases.where(F.col("phenophase_category") == category)


def animal_phenophases(phenophases: DataFrame, last_plant_class: int = 13) -> DataFrame:
    return phenophases.where(F.col("pheno_class_id") > last_plant_class)


def taxon_classes(species: DataFrame, kingdom: str = "Animalia") -> DataFrame:
    return species.where(F.col("kingdom") == kingdom).select("class_id").distinct()


def layer_details(layers: DataFrame, name: str) -> DataFrame:
    return layers.where(F.col("name") == name).select(
        "name", "title", "abstract", "dimension_name"
    )
