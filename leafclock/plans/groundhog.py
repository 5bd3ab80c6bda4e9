"""First leaves and flowers up to a calendar day, and the anomaly classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.operators import clean, raster, summary
from leafclock.params import BREAKS_GROUNDHOG, Params
from leafclock.sources.observations import scan_observations


def records(raw: DataFrame, p: Params, mmdd: str = "02-02", classes=(1, 7)) -> DataFrame:
    """This year's rows up to the day; missing states count as inside."""
    df = scan_observations(raw, years=[p.year], classes=classes)
    df = clean.restrict_states(df, p.allowed_states, keep_missing=True)
    df = clean.null_markers(clean.project_raw(df, "groundhog"))
    return clean.up_to_day(clean.exclude_species(df, p.excluded_species), p.year, mmdd)


def first_records(df: DataFrame) -> DataFrame:
    return clean.first_yes(df, clean.FIRST_YES_KEYS["groundhog"])


def day_summary(df: DataFrame) -> DataFrame:
    """Per class: rows and individuals, then first records without a prior no."""
    first = summary.missing_share(first_records(df), "prior_no", ["pheno_class_id"])
    first = first.withColumnRenamed("n_obs", "n_first")
    return summary.class_counts(df).join(first, "pheno_class_id", "left")


def class_frequency(cells: DataFrame, breaks=BREAKS_GROUNDHOG) -> DataFrame:
    """Cells per cool, normal and warm class."""
    classed = raster.classify(cells, breaks)
    return raster.frequency(classed, "class").withColumn(
        "label", raster.class_label(F.col("class"))
    )
