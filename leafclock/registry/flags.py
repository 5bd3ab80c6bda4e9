"""Pool sizes, distributions and row-level derivations."""

from pyspark.sql import functions as F

from leafclock.functions import labels
from leafclock.operators import anomaly, clean, pool
from leafclock.params import FUNC_TYPE_CODES
from leafclock.plans.anomalies import state_anomalies
from leafclock.registry.base import query
from leafclock.registry.cleaning import ANIMAL_OBS, FOLDED_SQL
from leafclock.registry.joins import STATE, compared
from leafclock.registry.standin import (
    BASE, CLEAN_SQL, OBS_SQL, P, P_ANIMALS, POOL, _case, chain, cur_prior, observations, pool_sql,
    split_sql,
)

IDS = ["site_id", "id", "pheno_class_id", "first_yes"]


@query(
    "a1_pool_sizes",
    POOL + "SELECT site_id, id, pheno_class_id, first_yes, n_obs_r, n_indiv_r, n_yrs_r FROM sized",
)
def sizes(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    return pool.pool_sizes(cur, prior, P).select(*IDS, "n_obs_r", "n_indiv_r", "n_yrs_r")


@query(
    "a2_pool_sites_animals",
    chain(CLEAN_SQL, FOLDED_SQL, ANIMAL_OBS, split_sql("phenophase_category"),
          pool_sql("phenophase_category", "site_id"))
    + """SELECT site_id, common_name, phenophase_category, first_yes, n_obs_r,
  n_indiv_r AS n_site_r, n_yrs_r FROM sized""",
)
def sizes_animals(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir, P_ANIMALS, "animals")
    return pool.pool_sizes(cur, prior, P_ANIMALS).select(
        "site_id", "common_name", "phenophase_category", "first_yes", "n_obs_r",
        F.col("n_indiv_r").alias("n_site_r"), "n_yrs_r",
    )


DIST_SQL = """dist AS (SELECT common_name, pheno_class_id, state, min(first_yes) AS "min",
  quantile_cont(first_yes, 0.05) AS qearly, quantile_cont(first_yes, 0.25) AS q25,
  quantile_cont(first_yes, 0.75) AS q75 FROM prior GROUP BY ALL)"""


@query(
    "a3_distribution",
    BASE + f""", {DIST_SQL} SELECT common_name, pheno_class_id, state, "min",
  round(qearly, 6) AS qearly, round(q25, 6) AS q25, round(q75, 6) AS q75 FROM dist""",
)
def dist(spark, sf_dir):
    _, prior = cur_prior(spark, sf_dir)
    return anomaly.distribution(prior, ["common_name", "pheno_class_id", "state"])


@query(
    "x1_tukey_whisker",
    BASE + f""", {DIST_SQL} SELECT common_name, pheno_class_id, state,
  round(q75 - q25, 6) AS iqr, round(q25 - 1.5 * (q75 - q25), 6) AS whisker FROM dist""",
)
def whisker(spark, sf_dir):
    out = anomaly.with_thresholds(dist(spark, sf_dir))
    return out.select("common_name", "pheno_class_id", "state", "iqr", "whisker")


@query(
    "x2_outlier_threshold",
    BASE + f""", {DIST_SQL} SELECT common_name, pheno_class_id, state,
  round(greatest(q25 - 1.5 * (q75 - q25), CAST("min" AS DOUBLE)), 6) AS outlier_threshold
  FROM dist""",
)
def threshold(spark, sf_dir):
    out = anomaly.with_thresholds(dist(spark, sf_dir))
    return out.select("common_name", "pheno_class_id", "state", "outlier_threshold")


@query(
    "x3_flags",
    POOL + """SELECT site_id, id, pheno_class_id, first_yes, early, outlier FROM compared""",
)
def flags(spark, sf_dir):
    return compared(spark, sf_dir).select(*IDS, "early", "outlier")


@query(
    "x4_earliest_flag",
    POOL + """SELECT site_id, id, pheno_class_id, first_yes, "min", earliest FROM compared""",
)
def earliest(spark, sf_dir):
    return compared(spark, sf_dir).select(*IDS, "min", "earliest")


@query(
    "f14_flagged",
    POOL + "SELECT site_id, id, pheno_class_id, first_yes, early, outlier FROM flags",
)
def only_flagged(spark, sf_dir):
    return clean.flagged(compared(spark, sf_dir)).select(*IDS, "early", "outlier")


@query("x5_eo_label", POOL + "SELECT id, pheno_class_id, eo, eo_rank FROM flags")
def eo(spark, sf_dir):
    return anomaly.flagged_rows(compared(spark, sf_dir)).select(
        "id", "pheno_class_id", "eo", "eo_rank"
    )


@query(
    "x6_yes_no",
    POOL + """SELECT id, pheno_class_id, CASE WHEN early = 1 THEN 'Yes' ELSE 'No' END AS early,
  CASE WHEN outlier = 1 THEN 'Yes' ELSE 'No' END AS outlier FROM flags""",
)
def yes_no(spark, sf_dir):
    rows = anomaly.flagged_rows(compared(spark, sf_dir))
    return rows.select(
        "id", "pheno_class_id", labels.yes_no(F.col("early") == 1).alias("early"),
        labels.yes_no(F.col("outlier") == 1).alias("outlier"),
    )


OBS = chain(CLEAN_SQL, OBS_SQL)


@query(
    "x7_doy_to_date",
    OBS + """SELECT id, pheno_class_id, "year",
  CAST(make_date("year", 1, 1) + (first_yes - 1) AS VARCHAR) AS firstyes FROM obs""",
)
def dates(spark, sf_dir):
    return observations(spark, sf_dir).select(
        "id", "pheno_class_id", "year", labels.doy_to_date("year", "first_yes").alias("firstyes")
    )


@query(
    "x8_func_type_code",
    OBS + f"""SELECT id, pheno_class_id, "year", func_type, {_case("func_type", FUNC_TYPE_CODES)} AS func_type2 FROM obs""",
)
def codes(spark, sf_dir):
    return observations(spark, sf_dir).select(
        "id", "pheno_class_id", "year", "func_type", labels.func_type_code().alias("func_type2")
    )


@query(
    "x9_labels",
    chain(CLEAN_SQL, OBS_SQL, gaps=True) + """SELECT site_id, id, pheno_class_id, "year",
  concat(common_name, '_', id) AS indiv, concat(common_name, '_', site_id) AS sppsite,
  concat(common_name, '_', id, ' (', coalesce(state, 'NA'), ')') AS panel FROM obs""",
)
def labels_(spark, sf_dir):
    return observations(spark, sf_dir, gaps=True).select(
        "site_id", "id", "pheno_class_id", "year", labels.indiv().alias("indiv"),
        labels.indiv("site_id").alias("sppsite"), labels.panel(labels.indiv()).alias("panel"),
    )


@query(
    "x10_composite_keys",
    chain(CLEAN_SQL, OBS_SQL, gaps=True) + """SELECT DISTINCT
  concat(coalesce(state, 'NA'), '_', common_name) AS state_spp,
  concat(coalesce(state, 'NA'), '_', common_name, '_', pheno_class_id) AS state_spp_ph,
  concat(common_name, '_', site_id, '_', pheno_class_id) AS spp_site_ph FROM obs""",
)
def composite(spark, sf_dir):
    return observations(spark, sf_dir, gaps=True).select(
        labels.joined("state", "common_name").alias("state_spp"),
        labels.joined("state", "common_name", "pheno_class_id").alias("state_spp_ph"),
        labels.joined("common_name", "site_id", "pheno_class_id").alias("spp_site_ph"),
    ).distinct()


TABLE_SQL = f"""eo AS (SELECT pheno_class_id, common_name, func_type,
  {_case("func_type", FUNC_TYPE_CODES)} AS func_type2,
  id, state, lat, lon, elev, first_yes,
  CAST(make_date(2001, 1, 1) + (first_yes - 1) AS VARCHAR) AS firstyes,
  CASE WHEN early = 1 THEN 'Yes' ELSE 'No' END AS early,
  CASE WHEN first_yes <= "min" THEN 'Yes' ELSE 'No' END AS earliest,
  CASE WHEN outlier = 1 THEN 'Yes' ELSE 'No' END AS outlier, n_yrs_r, n_obs_r FROM flags)"""
TABLE = POOL + ", " + TABLE_SQL


def eo_table(spark, sf_dir):
    return anomaly.flag_table(anomaly.flagged_rows(compared(spark, sf_dir)), P)


@query(
    "x11_detail_table",
    TABLE + """SELECT * EXCLUDE (n_obs_r, n_yrs_r) REPLACE (round_even(lat, 2) AS lat,
  round_even(lon, 2) AS lon), concat(n_obs_r, ' (', n_yrs_r, ')') AS numprior FROM eo""",
)
def detail(spark, sf_dir):
    return anomaly.detail_table(eo_table(spark, sf_dir))


@query("o1_order_flag_table", TABLE + """SELECT * EXCLUDE (first_yes) FROM eo
  ORDER BY pheno_class_id, func_type, common_name, state, first_yes""")
def ordered(spark, sf_dir):
    return anomaly.ordered_flag_table(eo_table(spark, sf_dir), P)


@query(
    "o3_order_state_listing",
    STATE + """SELECT pheno_class_id, concat(state, '_', common_name) AS state_spp, func_type,
  first_yes, "min", round(outlier_threshold, 6) AS outlier_threshold, round(q25, 6) AS q25,
  round(q75, 6) AS q75, early, outlier FROM sflags
  ORDER BY pheno_class_id, func_type, state_spp, first_yes""",
)
def state_listing(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    columns = ["pheno_class_id", "state_spp", "func_type", "first_yes"]
    return (
        state_anomalies(cur, prior, P)
        .select(*columns, "min", "outlier_threshold", "q25", "q75", "early", "outlier")
        .orderBy("pheno_class_id", "func_type", "state_spp", "first_yes")
    )


@query(
    "o4_sorted_labels",
    BASE + "SELECT DISTINCT concat(state, '_', common_name) AS state_spp FROM cur ORDER BY 1",
)
def sorted_labels(spark, sf_dir):
    cur, _ = cur_prior(spark, sf_dir)
    label = labels.joined("state", "common_name").alias("state_spp")
    return cur.select(label).distinct().orderBy("state_spp")
