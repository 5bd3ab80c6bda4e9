"""County spring index from yearly grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafclock.operators import county, raster, summary, zonal_store
from leafclock.sources.scratch import staged


def county_long(
    cells: DataFrame, cov: DataFrame, counties: DataFrame, year: int, min_prop: float = 0.90,
    store: str | None = None, years=(), indices=("leaf", "bloom"),
) -> DataFrame:
    """One row per county, index and year; the current year only where it is complete.

    ``counties`` maps ``poly_id`` to the county columns. The zonal means are small
    and read by every later step, so they are written once; so is the coverage, which
    depends on the grid only. With a ``store`` the prior ``years`` come from there, and only
    those that it lacks are computed.
    """
    cov = staged(cov, "coverage")
    if store is None:
        z = raster.zonal(cells, cov)
    else:
        prior = [(i, y) for i in indices for y in years if y != year]
        z = zonal_store.zonal_years(cells, cov, store, prior, fresh=[(i, year) for i in indices])
    z = staged(z, "zonal")
    z = raster.mask_incomplete(z, year, min_prop)
    return counties.join(z, "poly_id").select(
        "poly_id", *county.COUNTY, "index", "year", F.col("mean").alias("doy")
    )


def with_current(
    prior_cells: DataFrame, current: DataFrame, source: raster.CellGrid, grid: raster.CellGrid
) -> DataFrame:
    """Prior years plus the current year resampled to their grid."""
    return prior_cells.unionByName(raster.resample(current, source, grid))


def county_anomalies(long: DataFrame, year: int, first: int = 1991, last: int = 2020):
    """Current value, baseline and anomaly per county and index."""
    keys = [*county.COUNTY, "index"]
    return county.anomaly(long, year, first, last, keys)


def county_ranks(
    long: DataFrame, year: int, n: int = 40, inclusive: bool = False, na_counts: bool = True
):
    """Ranks against the prior years, with return intervals."""
    keys = [*county.COUNTY, "index"]
    ranks = county.rank_against_history(long, year, n, keys, na_counts)
    return ranks.withColumns(
        {
            "return_late": county.return_interval("n_later", n, inclusive),
            "return_early": county.return_interval("n_earlier", n, inclusive),
        }
    )


def output_table(long: DataFrame, year: int, n: int = 40, names=None) -> DataFrame:
    """The last n years and the current one of one index, with FIPS codes.

    Counties in rows with a column per year, or, if ``names`` lists counties, years in
    rows with a column per county.
    """
    rows = county.with_fips(county.last_years(long, year, n))
    if names is not None:
        return county.to_wide_by_year(rows, names)
    return county.to_wide(rows, range(year - n, year + 1), ["FIPS", *county.COUNTY])


def point_history(
    cells: DataFrame, points: DataFrame, grid: raster.CellGrid, keys, year: int, n: int = 40
) -> DataFrame:
    """At each point and index: current value, five numbers of the prior years, intervals.

    A point has one value per year, so the percentiles see at most n values.
    """
    layers = raster.value_at(cells, points, grid).where(F.col("year").between(year - n, year))
    now = F.max(F.when(F.col("year") == year, F.col("value")))
    by = [*keys, "index"]
    rows = layers.withColumn("currentyr", now.over(Window.partitionBy(*by)))
    rows = rows.where(F.col("year") < year)
    counts = rows.groupBy(*by, "currentyr").agg(
        F.count_if(F.col("value") > F.col("currentyr")).alias("n_later"),
        F.count_if(F.col("value") < F.col("currentyr")).alias("n_earlier"),
    )
    five = summary.five_numbers(rows, "value", by, short=True)
    return counts.join(five, by).withColumns({
        "return_late": county.return_interval("n_later", n),
        "return_early": county.return_interval("n_earlier", n),
    })
