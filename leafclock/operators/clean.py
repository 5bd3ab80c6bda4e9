"""Projection, filters and first-record selection of raw observations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafclock.functions.labels import day_of
from leafclock.params import Params

# Raw column -> clean column, per kind of download.
_COMMON = {
    "site_id": "site_id",
    "latitude": "lat",
    "longitude": "lon",
    "elevation_in_meters": "elev",
    "state": "state",
    "common_name": "common_name",
}
_TIMES = {
    "first_yes_year": "year",
    "first_yes_doy": "first_yes",
    "numdays_since_prior_no": "prior_no",
}
_SPECIES = {"species_id": "species_id", "species_functional_type": "func_type"}
_INDIVIDUAL = {"individual_id": "id"}
_PHASE = {"phenophase_description": "phenophase"}
_CLASS = {"pheno_class_id": "pheno_class_id"}
_FLAG = {"observed_status_conflict_flag": "flag"}

RAW_COLUMNS = {
    "plants": {**_COMMON, **_SPECIES, **_INDIVIDUAL, **_PHASE, **_CLASS, **_TIMES, **_FLAG},
    "autumn": {
        **_COMMON, **_SPECIES, **_INDIVIDUAL, "phenophase_id": "phenophase_id",
        **_PHASE, **_TIMES, **_FLAG,
    },
    "animals": {
        **_COMMON, **_SPECIES, "phenophase_category": "phenophase_category",
        **_PHASE, **_CLASS, **_TIMES, **_FLAG,
    },
    "groundhog": {
        **_COMMON, **_INDIVIDUAL, **_PHASE, **_CLASS,
        "first_yes_doy": "first_yes", "numdays_since_prior_no": "prior_no",
        "last_yes_doy": "last_yes", "numdays_until_next_no": "next_no",
    },
}

# What identifies one record per year, per kind.
FIRST_YES_KEYS = {
    "plants": ["id", "pheno_class_id", "year"],
    "autumn": ["id", "phenophase", "year"],
    "animals": ["common_name", "site_id", "phenophase_category", "year"],
    "groundhog": ["pheno_class_id", "id"],
}


def project_raw(df: DataFrame, kind: str = "plants") -> DataFrame:
    return df.select(*[F.col(raw).alias(new) for raw, new in RAW_COLUMNS[kind].items()])


def null_sentinels(df: DataFrame, columns, sentinels) -> DataFrame:
    """Replace marker values of missing data by null in the given columns."""
    markers = list(sentinels) if isinstance(sentinels, (list, tuple)) else [sentinels]
    new = {}
    for name in columns:
        value = F.col(name)
        for marker in markers:
            value = F.nullif(value, F.lit(marker).cast(df.schema[name].dataType))
        new[name] = value
    return df.withColumns(new)


def null_markers(df: DataFrame) -> DataFrame:
    """The usual markers: -9999 in numbers and text, empty text in the state."""
    has = set(df.columns)
    df = null_sentinels(df, [c for c in ("elev", "prior_no", "next_no") if c in has], -9999)
    df = null_sentinels(df, [c for c in ("flag",) if c in has], "-9999")
    return null_sentinels(df, ["state"], ["-9999", ""])


def drop_conflicts(df: DataFrame, flag: str = "flag") -> DataFrame:
    return df.where(F.col(flag).isNull()).drop(flag)


def recent_prior_no(df: DataFrame, max_days: int = 30) -> DataFrame:
    return df.where(F.col("prior_no") <= max_days)


def exclude_species(df: DataFrame, names) -> DataFrame:
    return df.where(~F.col("common_name").isin(*names)) if names else df


def restrict_states(df: DataFrame, states, keep_missing: bool = False) -> DataFrame:
    """Keep the given states; optionally also rows marked as having none."""
    allowed = list(states) + (["-9999"] if keep_missing else [])
    return df.where(F.col("state").isin(*allowed))


def up_to_day(df: DataFrame, year: int, mmdd: str = "02-02") -> DataFrame:
    return df.where(F.col("first_yes") <= day_of(year, mmdd))


def fold_categories(df: DataFrame) -> DataFrame:
    """Animal categories: leave out development, count method as activity."""
    category = F.col("phenophase_category")
    return df.where(category != "Development").withColumn(
        "phenophase_category", F.when(category == "Method", "Activity").otherwise(category)
    )


def first_yes(df: DataFrame, keys, ties=None) -> DataFrame:
    """First record per key by day; all other columns break ties, so that the
    result does not depend on input order.

    ``row_number() = 1`` is planned with a per-task limit before the shuffle, so
    a key that holds many rows still sends only one row per task.
    """
    if ties is None:
        lead = [c for c in ("site_id", "phenophase", "prior_no") if c in df.columns]
        ties = lead + sorted(c for c in df.columns if c not in lead)
        ties = [c for c in ties if c not in keys and c != "first_yes"]
    order = [F.col(c).asc_nulls_last() for c in ["first_yes", *ties]]
    return (
        df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("rn") == 1)
        .drop("rn")
    )


def clean_observations(df: DataFrame, p: Params, kind: str = "plants") -> DataFrame:
    """Raw download to one clean first record per key and year."""
    df = null_markers(project_raw(df, kind))
    df = exclude_species(df, p.excluded_species)
    df = recent_prior_no(drop_conflicts(df), p.max_prior_no)
    if kind == "animals":
        df = fold_categories(df)
    return first_yes(df, FIRST_YES_KEYS[kind])


def current_of(df: DataFrame, p: Params) -> DataFrame:
    return df.where(F.col("year") == p.year)


def prior_of(df: DataFrame, p: Params) -> DataFrame:
    return df.where(F.col("year").between(p.first_prior_year, p.year - 1))


def distinct_sites(df: DataFrame) -> DataFrame:
    return df.select("site_id", "lon", "lat").distinct()


def select_matching(df: DataFrame, pattern: str, keep=(), drop=(), first=()) -> DataFrame:
    """Columns by name: listed or matching, minus dropped, with some moved first."""
    names = [c for c in df.columns if c in keep or re.search(pattern, c)]
    names = [c for c in names if c not in drop]
    lead = [c for c in first if c in names]
    return df.select(*lead, *[c for c in names if c not in lead])


def rename_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.withColumnsRenamed(
        {c: re.sub(pattern, replacement, c) for c in df.columns if re.search(pattern, c)}
    )


def sufficient(df: DataFrame, min_obs: int, min_yrs: int, n_obs="n_obs_r", n_yrs="n_yrs_r"):
    return df.where((F.col(n_obs) >= min_obs) & (F.col(n_yrs) >= min_yrs))


def flagged(df: DataFrame) -> DataFrame:
    return df.where((F.col("early") == 1) | (F.col("outlier") == 1))
