"""Anomalous records by radius and by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.operators import anomaly, clean, fill, pool, refresh, state, summary
from leafclock.params import Params
from leafclock.sources.observations import in_period, scan_observations
from leafclock.sources.scratch import staged


def scoped(raw: DataFrame, p: Params, years=None) -> DataFrame:
    """Raw rows of the report: its years, classes, phenophases and period.

    Empty lists and no period mean no limit.
    """
    years = years if years is not None else [*p.prior_years, p.year]
    rows = scan_observations(raw, years, p.pheno_class_ids or None, p.phenophase_ids or None)
    return in_period(rows, *p.period, years=years) if p.period else rows


def prepare(
    raw: DataFrame, edges: DataFrame, site_elev: DataFrame, p: Params, kind: str = "plants",
    years=None,
) -> DataFrame:
    """Clean the raw rows in scope and fill state and elevation (all elevations in autumn).

    The cleaned rows are written once: the states are looked up from them and joined
    to them.
    """
    obs = staged(clean.clean_observations(scoped(raw, p, years), p, kind), "cleaned")
    df = fill.fill_state(obs, edges, p)
    return fill.fill_elevation(df, site_elev, overwrite=kind == "autumn")


def split(df: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Current rows, and prior rows of the species and phases seen this year.

    The rows are written once, as both sides are read several times.
    """
    df = staged(df.where(F.col("year").between(p.first_prior_year, p.year)), "observations")
    cur = staged(clean.current_of(df, p), "current")
    return cur, pool.restrict_to_current(clean.prior_of(df, p), cur, p.group_keys)


def radius_anomalies(cur: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Early and outlier rows against the pool within the radius."""
    return anomaly.flagged_rows(anomaly.compare_with_pool(cur, prior, p))


def radius_report(cur: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Flag table. Flagged rows keep their details, so nothing is joined back."""
    return anomaly.flag_table(radius_anomalies(cur, prior, p), p)


def incremental_report(
    raw: DataFrame, cache: str, edges: DataFrame, site_elev: DataFrame, p: Params, batch: str
) -> DataFrame:
    """Top up the cache of prior years, then compare the current year with it.

    Only the current year is cleaned anew, and what the cache lacks.
    """
    cur = staged(prepare(raw, edges, site_elev, p, years=[p.year]), "current")
    prior = refresh.refresh_prior(
        raw.sparkSession, raw, cache, cur, edges, site_elev, p, batch
    )
    return radius_anomalies(cur, pool.restrict_to_current(prior, cur, p.group_keys), p)


def radius_histograms(flags: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Histogram data behind each flagged row."""
    panels = anomaly.panel_days(staged(flags, "flags"), prior, p)
    return summary.histogram(panels, "first_yes", p.bins, [p.phase_key, "panel"], "n")


def state_anomalies(cur: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Early and outlier rows against all rows of the same state."""
    return state.flagged_in_state(state.compare_in_state(cur, prior, p))
