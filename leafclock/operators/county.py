"""County tables: long and wide forms, baselines, ranks and return intervals.

The long table has one row per county, index and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafclock.functions import labels

COUNTY = ["STATEFP", "COUNTYFP", "state", "county"]


def with_fips(df: DataFrame) -> DataFrame:
    fips = F.concat(labels.text("STATEFP"), labels.text("COUNTYFP"))
    return df.withColumn("FIPS", fips).withColumn(
        "name_FIPS", labels.joined("state", "county", "FIPS")
    )


def last_years(df: DataFrame, year: int, n: int = 40) -> DataFrame:
    """The current year and the n before it."""
    return df.where(F.col("year").between(year - n, year))


def last_years_wide(df: DataFrame, year: int, n: int = 40, prefix: str = "doy_") -> DataFrame:
    """The same on the wide table, by column name."""
    old = [
        c for c in df.columns
        if c.startswith(prefix) and int(c[len(prefix):]) < year - n
    ]
    return df.drop(*old)


def to_long(df: DataFrame, prefix: str = "doy_") -> DataFrame:
    """Year columns to rows; missing values stay as rows."""
    values = [c for c in df.columns if c.startswith(prefix)]
    keys = [c for c in df.columns if c not in values]
    return (
        df.unpivot(keys, values, "year", "doy")
        .withColumn("year", F.regexp_replace("year", f"^{prefix}", "").cast("int"))
    )


def to_wide(df: DataFrame, years, keys=tuple(COUNTY), prefix: str = "doy_") -> DataFrame:
    """Counties in rows, one column per year."""
    wide = df.groupBy(*keys).pivot("year", list(years)).agg(F.first("doy"))
    return wide.withColumnsRenamed({str(y): f"{prefix}{y}" for y in years})


def to_wide_by_year(df: DataFrame, names) -> DataFrame:
    """Years in rows, one column per county; ``names`` lists the columns wanted."""
    return df.groupBy("year").pivot("name_FIPS", list(names)).agg(F.first("doy"))


def _mean_of(first: int, last: int) -> Column:
    """Mean over the years, missing if any of them has no row or no value."""
    doy = F.when(F.col("year").between(first, last), F.col("doy"))
    return F.when(F.count(doy) == last - first + 1, F.avg(doy))


def _value_of(year: int) -> Column:
    return F.max(F.when(F.col("year") == year, F.col("doy")))


def baseline(df: DataFrame, first: int = 1991, last: int = 2020, keys=tuple(COUNTY)):
    """Mean over the baseline years of every county, missing if any of them is."""
    return df.groupBy(*keys).agg(_mean_of(first, last).alias("baseline"))


def anomaly(
    df: DataFrame, year: int, first: int = 1991, last: int = 2020, keys=tuple(COUNTY)
) -> DataFrame:
    """Current value, baseline, and the difference, for every county in one pass.

    A county without a row for the current year stays, with missing values.
    """
    both = df.groupBy(*keys).agg(
        _value_of(year).alias("currentyr"), _mean_of(first, last).alias("baseline")
    )
    return both.withColumn("anom", F.col("currentyr") - F.col("baseline"))


def anomaly_limits(df: DataFrame) -> DataFrame:
    """Symmetric range of the anomalies and its rounded label."""
    return df.agg(F.max(F.abs("anom")).alias("limit")).withColumn(
        "limit_round",
        F.when(F.col("limit") < 10, F.lit(5).cast("long")).otherwise(
            F.floor(F.col("limit") / 10) * 10
        ),
    )


def county_layer(counties: DataFrame, anom: DataFrame) -> DataFrame:
    """Anomaly attached to the county attribute table (matched counties)."""
    return counties.join(
        anom.select("STATEFP", "COUNTYFP", "anom"), ["STATEFP", "COUNTYFP"], "inner"
    )


def rank_against_history(
    df: DataFrame, year: int, n: int = 40, keys=tuple(COUNTY), na_counts: bool = True
) -> DataFrame:
    """Mean and median of the n prior years, and how many were earlier or later.

    A year without a row is a missing value, as in the wide table, and so is the current
    one: every county stays. ``na_counts`` counts a comparison with a missing value as a
    member; without it such years are left out. A county has at most n + 1 rows, so the
    window that hands it its current value is short.
    """
    keys = list(keys)
    doy = F.when(F.col("year").between(year - n, year - 1), F.col("doy"))
    known = F.count(doy) == n
    missing = F.lit(n) - F.count(F.when(F.col("currentyr").isNotNull(), doy))
    members = missing if na_counts else F.lit(0)
    return (
        df.withColumn("currentyr", _value_of(year).over(Window.partitionBy(*keys)))
        .groupBy(*keys, "currentyr")
        .agg(
            F.when(known, F.avg(doy)).alias("mean40"),
            F.when(known, F.percentile(doy, F.lit(0.5))).alias("median40"),
            (F.count_if(doy < F.col("currentyr")) + members).cast("long").alias("n_earlier"),
            (F.count_if(doy > F.col("currentyr")) + members).cast("long").alias("n_later"),
        )
    )


def return_interval(count: str, n_years: int = 40, inclusive: bool = False) -> Column:
    """Years per event at least this extreme. The plain form has no value when it
    never happened before; the inclusive one counts the current year itself."""
    n = F.col(count)
    if inclusive:
        return F.lit(float(n_years + 1)) / (n + 1)
    return F.when(n > 0, F.lit(float(n_years + 1)) / n)
