"""Flags of current records against a distribution of prior records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafclock.functions import labels, stats
from leafclock.operators.clean import flagged, sufficient
from leafclock.operators.pool import PLACE, PoolIndex, neighbour_pool, pool_days, pool_rows, pool_sizes
from leafclock.params import Params


def distribution(df: DataFrame, keys, lowerq: float = 0.05, value: str = "first_yes"):
    """Minimum and exact quantiles per group, from counts per value."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("q_n"))
    )
    probs = {"qearly": lowerq, "q25": 0.25, "q75": 0.75}
    out = stats.count_quantiles(counts, keys, value, "q_n", probs, [F.min(value).alias("min")])
    return out.select(*keys, "min", *probs)


def tukey_low(q25="q25", iqr="iqr") -> Column:
    return F.col(q25) - 1.5 * F.col(iqr)


def with_thresholds(df: DataFrame) -> DataFrame:
    """IQR, lower whisker, and the whisker raised to the minimum."""
    return (
        df.withColumn("iqr", F.col("q75") - F.col("q25"))
        .withColumn("whisker", tukey_low())
        .withColumn(
            "outlier_threshold",
            F.when(F.col("whisker") < F.col("min"), F.col("min").cast("double")).otherwise(
                F.col("whisker")
            ),
        )
    )


def flag(df: DataFrame, inclusive: bool = True) -> DataFrame:
    """0/1 flags; missing where there is no distribution."""
    day, limit = F.col("first_yes"), F.col("outlier_threshold")
    outlier = day <= limit if inclusive else day < limit
    return df.withColumns(
        {
            "early": (day < F.col("qearly")).cast("int"),
            "outlier": outlier.cast("int"),
            "earliest": (day <= F.col("min")).cast("int"),
        }
    )


def attach_distribution(cur: DataFrame, dist: DataFrame, keys) -> DataFrame:
    """Current rows with their group's distribution; rows without one drop out."""
    return cur.join(dist, list(keys), "inner")


def compare_with_pool(cur: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Every current row with a large enough pool, its distribution and flags."""
    sized = pool_sizes(cur, prior, p, individuals=False)
    enough = sufficient(sized, p.min_obs, p.min_yrs)
    out = flag(with_thresholds(enough), p.outlier_inclusive)
    return out.withColumn("indiv", labels.joined("common_name", p.unit))


def flagged_rows(compared: DataFrame) -> DataFrame:
    """Early and outlier rows with their panel and label."""
    return flagged(compared).withColumns(
        {
            "panel": labels.panel(F.col("indiv")),
            "eo": labels.eo_label(),
            "eo_rank": labels.eo_rank(),
        }
    )


def _with_shown(prior: DataFrame, shown: dict[str, Column] | None) -> DataFrame:
    return prior.withColumns({f"shown_{c}": value for c, value in (shown or {}).items()})


def _panel_columns(p: Params, shown: dict[str, Column] | None) -> list[Column]:
    phase = ["phenophase_id", "phenophase"] if p.phase_key == "phenophase" else [p.phase_key]
    columns = [
        "common_name", "func_type", *phase, "site_id", "lat", "lon", "elev", "state",
        "year", "first_yes",
    ]
    return [F.col(f"shown_{c}").alias(c) if c in (shown or {}) else F.col(c) for c in columns]


def panel_pool(flags: DataFrame, prior: DataFrame, p: Params, shown: dict[str, Column] | None = None) -> DataFrame:
    """Prior rows behind each flagged row, labelled with its panel.

    ``shown`` (name: expression of a prior row) replaces columns of the result. It is computed once per prior row, before
    rows are copied to panels, and takes no part in the pools.
    """
    pool = neighbour_pool(flags, _with_shown(prior, shown), p, carry=("indiv", "panel"))
    return pool.select(
        *_panel_columns(p, shown), F.col("cur_indiv").alias("indiv"), F.col("cur_panel").alias("panel"),
    )


def read_panels(
    index: PoolIndex, flags: DataFrame, prior: DataFrame, p: Params, panels=None,
    shown: dict[str, Column] | None = None,
) -> DataFrame:
    """``panel_pool`` out of a stored index, of all panels or of those named.

    What is stored does not grow with the pools; the rows of a panel are found when it is read.
    """
    key = [*p.group_keys, *PLACE]
    if panels is not None:
        flags = flags.where(F.col("panel").isin(*panels))
    rows = pool_rows(index, _with_shown(prior, shown), p, carry=flags.select(*key, "indiv", "panel"))
    return rows.select(*_panel_columns(p, shown), "indiv", "panel")


def panel_days(flags: DataFrame, prior: DataFrame, p: Params) -> DataFrame:
    """Prior records behind each panel, by day: what its histogram needs.

    A panel's days are dealt together, so that its histogram moves them no more.
    """
    days = pool_days(flags, prior, p, (p.phase_key, "panel")).repartition(p.phase_key, "panel")
    return days.groupBy(p.phase_key, "panel", "first_yes").agg(F.sum("n").alias("n"))


def panel_marks(flags: DataFrame, p: Params) -> DataFrame:
    """The current day to mark in each panel, told apart by label if outliers are shown."""
    eo = F.col("eo") if p.outliers_in_histogram else F.lit(None).cast("string")
    return flags.select(p.phase_key, "panel", "first_yes", eo.alias("eo"))


def attach_details(flags: DataFrame, cur: DataFrame, p: Params) -> DataFrame:
    """Observation details and pool sizes of flagged rows, by individual and phase."""
    details = cur.select(
        labels.joined("common_name", p.unit).alias("indiv"), p.phase_key,
        "common_name", p.unit, "lat", "lon", "elev", "func_type", "n_obs_r", "n_yrs_r",
    )
    narrow = flags.select("indiv", "state", p.phase_key, "first_yes", "min", "early", "outlier")
    # Both sides follow the current rows; the files they come from compress well.
    return narrow.join(details.hint("merge"), ["indiv", p.phase_key], "left")


def flag_table(rows: DataFrame, p: Params) -> DataFrame:
    """Report columns of flagged rows that already carry their details.

    Animals have no individuals; their table names the site instead.
    """
    phase = ["phenophase_id", "phenophase"] if p.phase_key == "phenophase" else [p.phase_key]
    return rows.select(
        *phase, "common_name", "func_type",
        labels.func_type_code("func_type", dict(p.func_types)).alias("func_type2"),
        p.unit, "state", "lat", "lon", "elev", "first_yes",
        labels.doy_to_date(F.lit(p.year), "first_yes").alias("firstyes"),
        labels.yes_no(F.col("early") == 1).alias("early"),
        labels.yes_no(F.col("first_yes") <= F.col("min")).alias("earliest"),
        labels.yes_no(F.col("outlier") == 1).alias("outlier"),
        "n_yrs_r", "n_obs_r",
    )


def ordered_flag_table(table: DataFrame, p: Params) -> DataFrame:
    phase = "phenophase_id" if p.phase_key == "phenophase" else p.phase_key
    order = [phase, "func_type", "common_name", "state", "first_yes"]
    columns = [c for c in table.columns if c != "first_yes"]
    return table.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(*columns)


def detail_table(table: DataFrame) -> DataFrame:
    """Rounded coordinates and ``records (years)`` as text."""
    prior = F.concat(labels.text("n_obs_r"), F.lit(" ("), labels.text("n_yrs_r"), F.lit(")"))
    return table.withColumns(
        {"lat": F.bround("lat", 2), "lon": F.bround("lon", 2), "numprior": prior}
    ).drop("n_obs_r", "n_yrs_r")


def early_points(flags: DataFrame, cur: DataFrame) -> DataFrame:
    """Early rows with the distinct coordinates of their site."""
    sites = cur.select("site_id", "lon", "lat").distinct()
    return flags.where(F.col("early") == 1).drop("lon", "lat").join(sites, "site_id", "left")


def class_labels(df: DataFrame, names: DataFrame, key: str = "pheno_class_id") -> DataFrame:
    """Name and title of the phase class, looked up by id."""
    dim = names.select(
        F.col("id").alias(key), F.col("name").alias("class_name"),
        labels.sentence_case(F.col("name")).alias("title"),
    )
    return df.join(dim, key, "left")
