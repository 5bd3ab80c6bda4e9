"""Fill in missing state and elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.operators.clean import restrict_states
from leafclock.operators.locate import locate_points
from leafclock.params import Params
from leafclock.sources.scratch import staged


def fill_state(df: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """State of the polygon around the site where none was given, then keep the
    allowed states. One location per site (the smallest coordinates) is looked up."""
    sites = (
        df.where(F.col("state").isNull())
        .groupBy("site_id")
        .agg(F.min(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("at"))
        .select("site_id", "at.x", "at.y")
    )
    found = (
        sites.join(locate_points(sites, edges), ["x", "y"])
        .groupBy("site_id")
        .agg(F.min("poly_id").alias("state_new"))
    )
    # Written first, so that a short list is broadcast and the rows stay in place.
    found = staged(found, "states-found")
    filled = (
        df.join(found, "site_id", "left")
        .withColumn("state", F.coalesce("state", "state_new"))
        .drop("state_new")
    )
    return restrict_states(filled, p.allowed_states)


def fill_elevation(df: DataFrame, site_elev: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rounded elevation of the site, for missing ones only or for all rows."""
    lookup = (
        site_elev.groupBy("site_id")
        .agg(F.min("elevation").alias("elevation"))
        .select("site_id", F.bround("elevation", 0).alias("elev_new"))
    )
    new = F.col("elev_new") if overwrite else F.coalesce("elev", "elev_new")
    return df.join(lookup, "site_id", "left").withColumn("elev", new).drop("elev_new")


def needs_elevation(df: DataFrame) -> DataFrame:
    return df.where(F.col("elev").isNull()).select("site_id", "lat", "lon").distinct()
