"""Counts, shares and report summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafclock.functions import stats
from leafclock.operators.quantiles import quantile_table
from leafclock.sources.scratch import staged


def group_sizes(df: DataFrame, keys, unit: str = "id") -> DataFrame:
    """Rows, individuals and years per group; a missing individual or year is one more.

    Rows shrink to counts per individual and year first. Individuals and years are then
    counted apart, both from that one exchange, so a large group is spread over tasks
    and no row is multiplied.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(unit).alias("unit"), "year").agg(F.count(F.lit(1)).alias("n"))
    units = (
        counts.groupBy(*keys, "unit").agg(F.sum("n").alias("n"))
        .groupBy(*keys).agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_indiv"))
    )
    years = counts.select(*keys, "year").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_years"))
    a, b = units.alias("a"), years.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, reduce(and_, same)).select("a.*", "b.n_years")


def site_coverage(sizes: DataFrame) -> DataFrame:
    """Per class: sites, and sites with long or well filled series.

    ``sizes`` is ``group_sizes`` per site, species and class.
    """
    long_series = (F.col("n_years") >= 10).cast("int")
    filled = ((F.col("n_years") >= 5) & (F.col("n_obs") >= 10)).cast("int")
    return (
        sizes.groupBy("pheno_class_id", "site_id")
        .agg(F.max(long_series).alias("s10"), F.max(filled).alias("s5_10"))
        .groupBy("pheno_class_id")
        .agg(
            F.count(F.lit(1)).alias("n_sites"),
            F.sum("s10").alias("n_sites_10"),
            F.sum("s5_10").alias("n_sites_5_10"),
        )
        .withColumns(
            {
                "prop_sites_10": F.col("n_sites_10") / F.col("n_sites"),
                "prop_sites_5_10": F.col("n_sites_5_10") / F.col("n_sites"),
            }
        )
    )


def class_counts(df: DataFrame) -> DataFrame:
    """Rows and individuals per class."""
    return (
        df.groupBy("pheno_class_id", "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pheno_class_id")
        .agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_indiv"))
    )


def missing_share(df: DataFrame, column: str, keys) -> DataFrame:
    """Rows, rows without a value, and their share."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.count_if(F.col(column).isNull()).alias(f"n_missing_{column}"),
        )
        .withColumn(f"prop_missing_{column}", F.col(f"n_missing_{column}") / F.col("n_obs"))
    )


def value_counts(df: DataFrame, columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _rounded_mean(column: str) -> Column:
    return F.bround(F.avg(column), 0).cast("long")


def summary_by(table: DataFrame, keys, species: bool = False) -> DataFrame:
    """Flagged rows per species or state: counts and mean pool sizes."""
    count = [F.count_distinct("common_name").alias("n_species")] if species else []
    return table.groupBy(*keys).agg(
        *count,
        *[F.count_if(F.col(c) == "Yes").alias(f"n_{c}") for c in ("early", "earliest", "outlier")],
        _rounded_mean("n_yrs_r").alias("mn_n_yrs"),
        _rounded_mean("n_obs_r").alias("mn_n_obs"),
    )


def histogram(df: DataFrame, column: str, bins: int, keys=(), weight: str | None = None) -> DataFrame:
    """Equal-width counts over the range of all panels; the last bin is closed.

    Rows count once, or as often as ``weight`` says.

    Rows shrink to counts per value, which are written and read for both the range
    and the bins. The range is a scalar subquery, so no row is joined to it.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    )
    counts = staged(counts, "value-counts")
    rng = counts.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    d = counts.withColumn("rng", rng)
    lo, hi = F.col("rng.lo"), F.col("rng.hi")
    where = F.floor((F.col("value") - lo) * bins / (hi - lo)).cast("int")
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(where, F.lit(bins - 1)))
    return (
        d.withColumn("bin", b)
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"), F.first("rng").alias("rng"))
        .select(
            *keys, "bin",
            (lo + F.col("bin") * (hi - lo) / bins).alias("x_from"),
            (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("x_to"),
            "n",
        )
    )


def panel_counts(panels: DataFrame, key: str = "pheno_class_id") -> DataFrame:
    """Panels per phase, and the rows of a two-column layout they need."""
    return (
        panels.groupBy(key)
        .agg(F.count_distinct("panel").alias("n_panels"))
        .withColumn("n_rows", F.ceil(F.col("n_panels") / 2))
    )


def five_numbers(df: DataFrame, column: str, keys=(), short: bool = False) -> DataFrame:
    """Minimum, quartiles, mean and maximum.

    Groups may have any number of different values; ``short`` ones, known to have few, need
    one aggregation only.
    """
    keys, probs = list(keys), {"q25": 0.25, "median": 0.5, "q75": 0.75}
    ends = F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max")
    if short:
        q = stats.quantiles(column, list(probs.values()))
        out = df.groupBy(*keys).agg(*ends, q.alias("q")).select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(probs)])
    else:
        a, b = df.groupBy(*keys).agg(*ends).alias("a"), quantile_table(df, keys, column, probs).alias("b")
        same = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
        out = a.join(b, same, "left").select("a.*", *probs)
    return out.select(*keys, "min", "q25", "median", "mean", "q75", "max")
