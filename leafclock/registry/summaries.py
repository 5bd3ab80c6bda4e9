"""Counts, shares, histograms and report summaries."""

from pyspark.sql import functions as F

from leafclock.functions import labels
from leafclock.operators import clean, refresh, summary
from leafclock.operators.anomaly import flagged_rows, panel_marks
from leafclock.plans.anomalies import radius_histograms
from leafclock.registry.base import query
from leafclock.registry.flags import TABLE, eo_table
from leafclock.registry.joins import compared, flags_and_prior
from leafclock.registry.standin import (
    BASE, CLEAN_SQL, OBS_SQL, P, POOL, PROJECTED_SQL, SITE_YEARS_SQL, chain, cur_prior,
    observations, raw, raw_sql, site_years, table,
)

OBS = chain(CLEAN_SQL, OBS_SQL)
PROJ = f"WITH {raw_sql()}, {PROJECTED_SQL}\n"


@query(
    "a4_state_sizes",
    BASE + """SELECT state, common_name, pheno_class_id, count(*) AS n_obs,
  count(DISTINCT id) AS n_indiv, count(DISTINCT "year") AS n_years FROM prior GROUP BY ALL""",
)
def state_sizes(spark, sf_dir):
    _, prior = cur_prior(spark, sf_dir)
    return summary.group_sizes(prior, ["state", "common_name", "pheno_class_id"])


SITE_KEYS = ["site_id", "lat", "lon", "elev", "common_name", "pheno_class_id"]
SITE_SIZES_SQL = """sizes AS (SELECT site_id, lat, lon, elev, common_name, pheno_class_id,
  count(*) AS n_obs, count(DISTINCT id) AS n_indiv, count(DISTINCT "year") AS n_years,
  concat(common_name, '_', site_id, '_', pheno_class_id) AS spp_site_ph FROM obs GROUP BY ALL)"""


def site_sizes(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return summary.group_sizes(obs, SITE_KEYS).withColumn(
        "spp_site_ph", labels.joined("common_name", "site_id", "pheno_class_id")
    )


@query("a5_site_sizes", f"{OBS}, {SITE_SIZES_SQL} SELECT * FROM sizes")
def site_sizes_(spark, sf_dir):
    return site_sizes(spark, sf_dir)


# Years and individuals that are missing in places count as one more value each.
HOLES_SQL = """holes AS (SELECT state, common_name, CASE WHEN site_id % 3 > 0 THEN id END AS id,
  CASE WHEN id % 4 > 0 THEN "year" END AS "year" FROM obs)"""


@query(
    "a4_sizes_with_holes",
    f"""{OBS}, {HOLES_SQL} SELECT state, common_name, count(*) AS n_obs,
  count(DISTINCT id) + max(CAST(id IS NULL AS INT)) AS n_indiv,
  count(DISTINCT "year") + max(CAST("year" IS NULL AS INT)) AS n_years FROM holes GROUP BY ALL""",
)
def sizes_with_holes(spark, sf_dir):
    holes = observations(spark, sf_dir).select(
        "state", "common_name", F.when(F.col("site_id") % 3 > 0, F.col("id")).alias("id"),
        F.when(F.col("id") % 4 > 0, F.col("year")).alias("year"),
    )
    return summary.group_sizes(holes, ["state", "common_name"])


@query(
    "a6_site_coverage",
    f"""{OBS}, {SITE_SIZES_SQL}, c AS (SELECT pheno_class_id, count(DISTINCT site_id) AS n_sites,
  count(DISTINCT CASE WHEN n_years >= 10 THEN site_id END) AS n_sites_10,
  count(DISTINCT CASE WHEN n_years >= 5 AND n_obs >= 10 THEN site_id END) AS n_sites_5_10
  FROM sizes GROUP BY 1)
SELECT *, round(n_sites_10 / n_sites, 6) AS prop_sites_10,
  round(n_sites_5_10 / n_sites, 6) AS prop_sites_5_10 FROM c""",
)
def coverage(spark, sf_dir):
    return summary.site_coverage(site_sizes(spark, sf_dir))


@query(
    "a7_class_counts",
    OBS + """SELECT pheno_class_id, count(*) AS n_obs, count(DISTINCT id) AS n_indiv
  FROM obs GROUP BY 1""",
)
def classes(spark, sf_dir):
    return summary.class_counts(observations(spark, sf_dir))


@query(
    "a8_missing_share",
    PROJ + """SELECT pheno_class_id, count(*) AS n_obs,
  count(*) - count(prior_no) AS n_missing_prior_no,
  round((count(*) - count(prior_no)) / count(*), 6) AS prop_missing_prior_no
  FROM proj GROUP BY 1""",
)
def missing(spark, sf_dir):
    df = clean.null_markers(clean.project_raw(raw(spark, sf_dir)))
    return summary.missing_share(df, "prior_no", ["pheno_class_id"])


@query(
    "a9_value_counts",
    PROJ + """SELECT phenophase_category, phenophase, count(*) AS n FROM proj GROUP BY ALL""",
)
def counts(spark, sf_dir):
    df = clean.project_raw(raw(spark, sf_dir), "animals")
    return summary.value_counts(df, ["phenophase_category", "phenophase"])


SUMMARY = """CAST(count(*) FILTER (early = 'Yes') AS BIGINT) AS n_early,
  CAST(count(*) FILTER (earliest = 'Yes') AS BIGINT) AS n_earliest,
  CAST(count(*) FILTER (outlier = 'Yes') AS BIGINT) AS n_outlier,
  CAST(round_even(avg(n_yrs_r), 0) AS BIGINT) AS mn_n_yrs,
  CAST(round_even(avg(n_obs_r), 0) AS BIGINT) AS mn_n_obs"""


@query("a10_summary_species", f"{TABLE} SELECT common_name, {SUMMARY} FROM eo GROUP BY 1")
def by_species(spark, sf_dir):
    return summary.summary_by(eo_table(spark, sf_dir), ["common_name"])


@query(
    "a11_summary_state",
    f"""{TABLE} SELECT state, count(DISTINCT common_name) AS n_species, {SUMMARY}
  FROM eo GROUP BY 1""",
)
def by_state(spark, sf_dir):
    return summary.summary_by(eo_table(spark, sf_dir), ["state"], species=True)


def hist_sql(source: str, column: str, bins: int, keys: str) -> str:
    """Equal-width bins over the whole range, last bin closed."""
    return f"""SELECT {keys}, bin, round(lo + bin * (hi - lo) / {bins}, 6) AS x_from,
  round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS x_to, count(*) AS n FROM (
  SELECT {keys}, lo, hi, CAST(least(floor(({column} - lo) * {bins} / (hi - lo)), {bins} - 1) AS INT)
    AS bin FROM {source}, (SELECT CAST(min({column}) AS DOUBLE) AS lo,
      CAST(max({column}) AS DOUBLE) AS hi FROM {source}) r) b GROUP BY ALL"""


@query("a12_histogram", OBS + hist_sql("obs", "first_yes", 30, "pheno_class_id"))
def histogram(spark, sf_dir):
    return summary.histogram(observations(spark, sf_dir), "first_yes", 30, ["pheno_class_id"])


PANEL_ROWS_SQL = """panel_rows AS (SELECT f.pheno_class_id, f.panel, q.pf AS first_yes
  FROM flags f JOIN pool q USING (id, pheno_class_id))"""


@query(
    "a12_panel_histogram",
    f"{POOL}, {PANEL_ROWS_SQL} " + hist_sql("panel_rows", "first_yes", 60, "pheno_class_id, panel"),
)
def panel_histogram(spark, sf_dir):
    flags, prior = flags_and_prior(spark, sf_dir)
    return radius_histograms(flags, prior, P)


@query(
    "a16_cache_state",
    BASE + """SELECT pheno_class_id, max("year") AS last_year,
  count(DISTINCT species_id) AS n_species FROM prior GROUP BY 1""",
)
def cache_state(spark, sf_dir):
    _, prior = cur_prior(spark, sf_dir)
    last, known = refresh.cache_state(prior)
    n = known.groupBy("pheno_class_id").agg(F.count(F.lit(1)).alias("n_species"))
    return last.join(n, "pheno_class_id")


@query(
    "a17_panel_counts",
    POOL + """SELECT pheno_class_id, count(DISTINCT panel) AS n_panels,
  CAST(ceil(count(DISTINCT panel) / 2) AS BIGINT) AS n_rows FROM flags GROUP BY 1""",
)
def panel_counts(spark, sf_dir):
    return summary.panel_counts(flagged_rows(compared(spark, sf_dir)))


@query(
    "a18_five_numbers",
    f"""WITH {SITE_YEARS_SQL} SELECT COUNTYFP, round(min(doy), 6) AS "min",
  round(quantile_cont(doy, 0.25), 6) AS q25, round(quantile_cont(doy, 0.5), 6) AS median,
  round(avg(doy), 6) AS mean, round(quantile_cont(doy, 0.75), 6) AS q75,
  round(max(doy), 6) AS "max" FROM long WHERE "year" < 2001 GROUP BY 1""",
)
def five(spark, sf_dir):
    rows = site_years(spark, sf_dir).where("year < 2001")
    return summary.five_numbers(rows, "doy", ["COUNTYFP"])


UNIT_PRICE = "l_extendedprice / (l_quantity + l_discount + l_tax)"


@query(
    "a18_continuous_groups",
    f"""SELECT l_returnflag, round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q25,
  round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q75,
  round(max(v), 6) AS "max" FROM (SELECT l_returnflag, CASE WHEN l_partkey % 11 > 0 THEN {UNIT_PRICE} END AS v
  FROM lineitem) GROUP BY 1""",
)
def five_of_groups(spark, sf_dir):
    """Three groups with nearly as many different values as rows."""
    price = F.expr(f"CASE WHEN l_partkey % 11 > 0 THEN {UNIT_PRICE} END")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", price.alias("v"))
    return summary.five_numbers(rows, "v", ["l_returnflag"])


@query(
    "a18_continuous_whole",
    f"""SELECT round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median,
  round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS "max"
  FROM (SELECT {UNIT_PRICE} AS v FROM lineitem)""",
)
def five_of_all(spark, sf_dir):
    """The whole table as one group."""
    return summary.five_numbers(table(spark, sf_dir, "lineitem").select(F.expr(UNIT_PRICE).alias("v")), "v")


@query("a17_panel_marks", POOL + "SELECT pheno_class_id, panel, first_yes, eo FROM flags")
def marks(spark, sf_dir):
    p = P.with_(outliers_in_histogram=True)
    return panel_marks(flagged_rows(compared(spark, sf_dir)), p)
