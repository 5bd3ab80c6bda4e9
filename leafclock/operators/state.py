"""The same comparison within a state instead of a radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.functions import labels, stats
from leafclock.operators.anomaly import attach_distribution, flag, with_thresholds
from leafclock.operators.clean import flagged, prior_of, sufficient
from leafclock.operators.pool import restrict_to_current
from leafclock.params import Params


def state_keys(p: Params) -> list[str]:
    return ["state", *p.group_keys]


def with_state_labels(df: DataFrame, p: Params) -> DataFrame:
    """Text labels of the composite keys, for output only."""
    return df.withColumns(
        {
            "state_spp": labels.joined("state", "common_name"),
            "state_spp_ph": labels.joined("state", "common_name", p.phase_key),
        }
    )


def state_distribution(prior: DataFrame, p: Params) -> DataFrame:
    """Sizes, minimum and quantiles per state, species and phase, in one pass.

    Records shrink to counts per day before anything is ranked, so a state with many
    rows costs no more than its days.
    """
    keys, years = state_keys(p), p.prior_years
    counts = (
        prior.where(F.col("first_yes").isNotNull())
        .select(*keys, "first_yes", *stats.year_bits(F.col("year"), years))
        .groupBy(*keys, "first_yes")
        .agg(F.count(F.lit(1)).alias("n"), *stats.or_years(years))
    )
    extra = [F.sum("n").alias("n_obs"), F.min("first_yes").alias("min"), *stats.or_years(years)]
    probs = {"qearly": p.lowerq, "q25": 0.25, "q75": 0.75}
    out = stats.count_quantiles(counts, keys, "first_yes", "n", probs, extra)
    return out.withColumn("n_years", stats.count_years(years)).drop(*stats.year_words(years))


def compare_in_state(cur: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Current rows flagged against all prior rows of their state, species, phase."""
    keys = state_keys(p)
    # A missing state or species still forms a group, as its label would.
    known = {c: F.coalesce(c, F.lit("NA")) for c in ("state", "common_name")}
    cur, prior = cur.withColumns(known), prior_of(prior, p).withColumns(known)
    dist = state_distribution(restrict_to_current(prior, cur, keys), p)
    dist = with_thresholds(sufficient(dist, p.min_obs, p.min_yrs, "n_obs", "n_years"))
    return with_state_labels(flag(attach_distribution(cur, dist, keys), inclusive=False), p)


def flagged_in_state(compared: DataFrame) -> DataFrame:
    return flagged(compared).withColumns(
        {
            "panel": labels.panel(F.col("common_name")),
            "eo": labels.eo_label(),
            "eo_rank": labels.eo_rank(),
        }
    )


def state_panels(prior: DataFrame, flags: DataFrame, p: Params) -> DataFrame:
    """Per flagged state and species: rows of the whole range and of the state."""
    columns = ["common_name", "state", "func_type", p.phase_key, "year", "first_yes"]
    panels = flags.select(*state_keys(p), "panel").distinct()
    # Labels are made once per row, not once per row and panel.
    rows = with_state_labels(prior.select(*columns), p)
    whole = rows.join(panels.drop("state"), p.group_keys).withColumn("group", F.lit("All"))
    own = rows.join(panels, state_keys(p)).withColumn("group", F.lit("State"))
    return whole.unionByName(own).select(
        *p.group_keys, *[c for c in columns if c not in p.group_keys], "panel", "group", "state_spp", "state_spp_ph")


def state_panel_days(prior: DataFrame, flags: DataFrame, p: Params) -> DataFrame:
    """The same as counts per day: (group, panel, phase, first_yes, n).

    Prior rows shrink to counts first, so a hot species is not copied per flagged state.
    """
    panels = flags.select(*state_keys(p), "panel").distinct()
    days = prior.groupBy(*state_keys(p), "first_yes").agg(F.count(F.lit(1)).alias("n"))
    whole = days.groupBy(*p.group_keys, "first_yes").agg(F.sum("n").alias("n"))
    columns = ["group", "panel", p.phase_key, "first_yes", "n"]
    all_ = whole.join(panels.drop("state"), p.group_keys).withColumn("group", F.lit("All"))
    own = days.join(panels, state_keys(p)).withColumn("group", F.lit("State"))
    return all_.select(*columns).unionByName(own.select(*columns))
