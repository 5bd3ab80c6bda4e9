"""The four reports end to end, and the incremental refresh."""

from pyspark.sql import functions as F

from leafclock.operators import anomaly, clean, summary
from leafclock.operators.refresh import compact_cache, read_cache, refresh_prior
from leafclock.params import FUNC_TYPE_CODES
from leafclock.plans import anomalies, groundhog, spring_index
from leafclock.operators.raster import coverage
from leafclock.registry.base import query
from leafclock.registry.cleaning import ANIMAL_OBS, FOLDED_SQL
from leafclock.registry.flags import TABLE
from leafclock.registry.grids import (
    COVERAGE_SQL, MASK_SQL, MIXED_SQL, ZONAL_SQL, mixed_cells,
)
from leafclock.registry.joins import FILLED_SQL, STATE
from leafclock.registry.standin import (
    ANOMALY_CELLS_SQL, AUTUMN_COLUMNS, CELLS_SQL, CLEAN_SQL, COUNTY_SQL, GRID, OBS_SQL, P, P_ANIMALS,
    P_AUTUMN, PLANT_COLUMNS, PROJECTED_SQL, _case, anomaly_cells, chain, counties, cur_prior, edges,
    first_sql, pool_sql, raw, raw_sql, site_elevation, split_sql, table, yearly_cells,
)
from leafclock.registry.grids import CLASS_SQL
from leafclock.sources.scratch import scratch_dir, staged
from leafclock.sources.versions import Batches


@query("g1_radius_report", TABLE + "SELECT * FROM eo")
def radius(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    return anomalies.radius_report(cur, prior, P)


REFILLED_SQL = f"""clean0 AS (SELECT * FROM clean), {FILLED_SQL.replace("FROM obs", "FROM obs0")},
obs AS (SELECT {PLANT_COLUMNS.replace(" elev,", "")},
  coalesce(elev, round_even(s_acctbal, 0)) AS elev
  FROM filled LEFT JOIN supplier ON s_suppkey = site_id)"""
FILLED_POOL = chain(
    CLEAN_SQL,
    OBS_SQL.replace("obs AS", "obs0 AS", 1),
    REFILLED_SQL.replace("SELECT obs.*", "SELECT obs0.*"),
    split_sql(),
    pool_sql(),
    gaps=True,
)
_FLAG_COLUMNS = """id, pheno_class_id, site_id, state, elev, first_yes, "min",
  round(qearly, 6) AS qearly, n_obs_r, n_yrs_r, early, outlier, panel, eo"""


@query("g1_radius_from_raw", FILLED_POOL + f"SELECT {_FLAG_COLUMNS} FROM flags")
def radius_from_raw(spark, sf_dir):
    obs = anomalies.prepare(
        raw(spark, sf_dir, gaps=True), edges(spark, sf_dir), site_elevation(spark, sf_dir), P
    )
    cur, prior = anomalies.split(obs, P)
    return anomalies.radius_anomalies(cur, prior, P).select(
        "id", "pheno_class_id", "site_id", "state", "elev", "first_yes", "min", "qearly",
        "n_obs_r", "n_yrs_r", "early", "outlier", "panel", "eo",
    )


@query("g1_incremental", FILLED_POOL + f"SELECT {_FLAG_COLUMNS} FROM flags")
def incremental(spark, sf_dir):
    """A cache as of two years earlier for some species, topped up and compared with."""
    path = scratch_dir(spark, "cache")
    source = raw(spark, sf_dir, gaps=True)
    shapes, elev = edges(spark, sf_dir), site_elevation(spark, sf_dir)
    cur = staged(anomalies.prepare(source, shapes, elev, P, years=[P.year]), "current")
    refresh_prior(spark, source, path, cur.where("species_id <= 4"), shapes, elev, P.with_(year=1999), "a")
    return anomalies.incremental_report(source, path, shapes, elev, P, "b").select(
        "id", "pheno_class_id", "site_id", "state", "elev", "first_yes", "min", "qearly",
        "n_obs_r", "n_yrs_r", "early", "outlier", "panel", "eo",
    )


AUTUMN_POOL = chain(
    """late AS (SELECT * REPLACE (round_even(s_acctbal, 0) AS elev) FROM clean_all
  JOIN supplier ON s_suppkey = site_id WHERE phenophase_id = 498
  AND strftime(make_date("year", 1, 1) + CAST(first_yes - 1 AS INT), '%m-%d') >= '07-01')""",
    first_sql(AUTUMN_COLUMNS, 'id, phenophase, "year"', "late"),
    split_sql("phenophase"),
    pool_sql("phenophase"),
).replace("late AS", CLEAN_SQL.replace("clean AS", "clean_all AS", 1) + ",\nlate AS", 1)


def autumn_flags(spark, sf_dir):
    obs = anomalies.prepare(
        raw(spark, sf_dir), edges(spark, sf_dir), site_elevation(spark, sf_dir), P_AUTUMN, "autumn"
    )
    cur, prior = anomalies.split(obs, P_AUTUMN)
    return anomalies.radius_anomalies(cur, prior, P_AUTUMN)


@query(
    "g1_autumn",
    AUTUMN_POOL + """SELECT id, phenophase_id, phenophase, site_id, first_yes, "min",
  round(qearly, 6) AS qearly, n_obs_r, n_yrs_r, early, outlier, panel FROM flags""",
)
def autumn(spark, sf_dir):
    return autumn_flags(spark, sf_dir).select(
        "id", "phenophase_id", "phenophase", "site_id", "first_yes", "min", "qearly", "n_obs_r",
        "n_yrs_r", "early", "outlier", "panel",
    )


@query(
    "g1_autumn_summary",
    AUTUMN_POOL + """SELECT phenophase, common_name, sum(early)::BIGINT AS n_early,
  sum(earliest)::BIGINT AS n_earliest, sum(outlier)::BIGINT AS n_outlier,
  CAST(round_even(avg(n_yrs_r), 0) AS BIGINT) AS mn_n_yrs,
  CAST(round_even(avg(n_obs_r), 0) AS BIGINT) AS mn_n_obs FROM flags GROUP BY ALL""",
)
def autumn_summary(spark, sf_dir):
    table_ = anomaly.flag_table(autumn_flags(spark, sf_dir), P_AUTUMN)
    return summary.summary_by(table_, ["phenophase", "common_name"])


@query(
    "g1_autumn_by_state",
    AUTUMN_POOL + """SELECT phenophase, state, count(DISTINCT common_name) AS n_species,
  sum(early)::BIGINT AS n_early, sum(earliest)::BIGINT AS n_earliest,
  sum(outlier)::BIGINT AS n_outlier, CAST(round_even(avg(n_yrs_r), 0) AS BIGINT) AS mn_n_yrs,
  CAST(round_even(avg(n_obs_r), 0) AS BIGINT) AS mn_n_obs FROM flags GROUP BY ALL""",
)
def autumn_by_state(spark, sf_dir):
    table_ = anomaly.flag_table(autumn_flags(spark, sf_dir), P_AUTUMN)
    return summary.summary_by(table_, ["phenophase", "state"], species=True)


ANIMAL_POOL = chain(
    CLEAN_SQL, FOLDED_SQL, ANIMAL_OBS, split_sql("phenophase_category"),
    pool_sql("phenophase_category", "site_id"),
)


@query(
    "g1_animals",
    ANIMAL_POOL + """SELECT indiv AS sppsite, common_name, func_type, phenophase_category, site_id,
  first_yes, "min", round(qearly, 6) AS qearly, round(q25, 6) AS q25, round(q75, 6) AS q75,
  n_obs_r, n_yrs_r, early, outlier, panel, eo FROM flags""",
)
def animals(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir, P_ANIMALS, "animals")
    return anomalies.radius_anomalies(cur, prior, P_ANIMALS).select(
        F.col("indiv").alias("sppsite"), "common_name", "func_type", "phenophase_category",
        "site_id", "first_yes", "min", "qearly", "q25", "q75", "n_obs_r", "n_yrs_r", "early",
        "outlier", "panel", "eo",
    ).orderBy("func_type", "sppsite", "phenophase_category")


@query(
    "g1_animals_report",
    ANIMAL_POOL + f"""SELECT phenophase_category, common_name, func_type,
  {_case("func_type", FUNC_TYPE_CODES)} AS func_type2, site_id, state, first_yes,
  CASE WHEN early = 1 THEN 'Yes' ELSE 'No' END AS early,
  CASE WHEN outlier = 1 THEN 'Yes' ELSE 'No' END AS outlier, n_yrs_r, n_obs_r FROM flags""",
)
def animals_report(spark, sf_dir):
    obs = anomalies.prepare(
        raw(spark, sf_dir), edges(spark, sf_dir), site_elevation(spark, sf_dir), P_ANIMALS, "animals"
    )
    cur, prior = anomalies.split(obs, P_ANIMALS)
    return anomalies.radius_report(cur, prior, P_ANIMALS).select(
        "phenophase_category", "common_name", "func_type", "func_type2", "site_id", "state",
        "first_yes", "early", "outlier", "n_yrs_r", "n_obs_r",
    )


@query(
    "g2_state_anomalies",
    STATE + """SELECT site_id, id, pheno_class_id, common_name, state, func_type, first_yes, "min",
  round(qearly, 6) AS qearly, round(q25, 6) AS q25, round(q75, 6) AS q75,
  round(outlier_threshold, 6) AS outlier_threshold, early, outlier, panel, eo FROM sflags""",
)
def by_state(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    return anomalies.state_anomalies(cur, prior, P).select(
        "site_id", "id", "pheno_class_id", "common_name", "state", "func_type", "first_yes", "min",
        "qearly", "q25", "q75", "outlier_threshold", "early", "outlier", "panel", "eo",
    )


KEYS = 'STATEFP, COUNTYFP, state, county, "index"'
LONG_SQL = f"""{MIXED_SQL}, {COVERAGE_SQL}, {ZONAL_SQL}, {MASK_SQL}, {COUNTY_SQL},
long AS (SELECT poly_id, {KEYS}, "year", mean AS doy FROM county JOIN masked USING (poly_id))"""


def county_long(spark, sf_dir):
    cells = mixed_cells(spark, sf_dir)
    cov = coverage(edges(spark, sf_dir), GRID)
    return spring_index.county_long(cells, cov, counties(spark, sf_dir), 2001)


@query(
    "g3_county_index",
    f"""WITH {LONG_SQL} SELECT poly_id, {KEYS}, "year", round(doy, 6) AS doy FROM long""",
)
def county_index(spark, sf_dir):
    return county_long(spark, sf_dir)


@query(
    "g3_county_anomalies",
    f"""WITH {LONG_SQL}, wide AS (SELECT {KEYS}, max(doy) FILTER ("year" = 2001) AS currentyr,
  CASE WHEN count(doy) FILTER ("year" BETWEEN 1996 AND 2000) = 5
    THEN avg(doy) FILTER ("year" BETWEEN 1996 AND 2000) END AS baseline FROM long GROUP BY ALL)
SELECT {KEYS}, round(currentyr, 6) AS currentyr, round(baseline, 6) AS baseline,
  round(currentyr - baseline, 6) AS anom FROM wide""",
)
def county_anomalies(spark, sf_dir):
    return spring_index.county_anomalies(county_long(spark, sf_dir), 2001, 1996, 2000)


@query(
    "g3_county_ranks",
    f"""WITH {LONG_SQL}, r AS (SELECT {KEYS}, currentyr,
  CASE WHEN count(doy) = 6 THEN avg(doy) END AS mean40,
  CASE WHEN count(doy) = 6 THEN quantile_cont(doy, 0.5) END AS median40,
  count(*) FILTER (doy < currentyr) + 6 - count(doy + currentyr) AS n_earlier,
  count(*) FILTER (doy > currentyr) + 6 - count(doy + currentyr) AS n_later
  FROM (SELECT *, max(doy) FILTER ("year" = 2001) OVER (PARTITION BY {KEYS}) AS currentyr FROM long) w
  WHERE "year" < 2001 GROUP BY {KEYS}, currentyr)
SELECT {KEYS}, round(currentyr, 6) AS currentyr, round(mean40, 6) AS mean40,
  round(median40, 6) AS median40, n_earlier, n_later,
  CASE WHEN n_later > 0 THEN round(7.0 / n_later, 6) END AS return_late,
  CASE WHEN n_earlier > 0 THEN round(7.0 / n_earlier, 6) END AS return_early FROM r""",
)
def county_ranks(spark, sf_dir):
    return spring_index.county_ranks(county_long(spark, sf_dir), 2001, 6)


_WIDE = ", ".join(
    f'round(max(doy) FILTER ("year" = {y}), 6) AS doy_{y}' for y in range(1995, 2002)
)


@query(
    "g3_output_table",
    f"""WITH {LONG_SQL} SELECT concat(STATEFP, COUNTYFP) AS FIPS, STATEFP, COUNTYFP, state, county,
  {_WIDE} FROM long WHERE "index" = 'bloom' GROUP BY ALL""",
)
def output_table(spark, sf_dir):
    long = county_long(spark, sf_dir).where("index = 'bloom'")
    return spring_index.output_table(long, 2001, 6)


@query(
    "g3_point_history",
    f"""WITH {CELLS_SQL}, layers AS (SELECT s_suppkey, "index", "year", "value"
  FROM (SELECT s_suppkey, -100 + ((s_suppkey * 61) % 100) * CAST(0.05 AS DOUBLE) AS px,
    30 + ((s_suppkey * 37) % 100) * CAST(0.05 AS DOUBLE) AS py FROM supplier) p
  JOIN cells ON "row" = CAST(floor((35.0 - py) / 0.125) AS INT)
    AND col = CAST(floor((px + 100.0) / 0.125) AS INT)),
now AS (SELECT s_suppkey, "index", "value" AS cur FROM layers WHERE "year" = 2001)
SELECT s_suppkey, "index", round(cur, 6) AS currentyr, count(*) FILTER ("value" > cur) AS n_later,
  count(*) FILTER ("value" < cur) AS n_earlier, round(min("value"), 6) AS "min",
  round(quantile_cont("value", 0.25), 6) AS q25, round(quantile_cont("value", 0.5), 6) AS median,
  round(avg("value"), 6) AS mean, round(quantile_cont("value", 0.75), 6) AS q75,
  round(max("value"), 6) AS "max",
  CASE WHEN count(*) FILTER ("value" > cur) > 0 THEN round(7.0 / count(*) FILTER ("value" > cur), 6) END
    AS return_late,
  CASE WHEN count(*) FILTER ("value" < cur) > 0 THEN round(7.0 / count(*) FILTER ("value" < cur), 6) END
    AS return_early
FROM layers LEFT JOIN now USING (s_suppkey, "index") WHERE "year" < 2001 GROUP BY s_suppkey, "index", cur""",
)
def point_history(spark, sf_dir):
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.lit(-100) + ((s * 61) % 100) * 0.05).alias("lon"),
        (F.lit(30) + ((s * 37) % 100) * 0.05).alias("lat"),
    )
    return spring_index.point_history(yearly_cells(spark, sf_dir), points, GRID, ["s_suppkey"], 2001, 6)


GH_SQL = f"""WITH {raw_sql(True)}, gh AS (SELECT site_id, latitude AS lat, longitude AS lon,
  individual_id AS id, phenophase_description AS phenophase, common_name, pheno_class_id,
  NULLIF(elevation_in_meters, -9999) AS elev, NULLIF(state, '-9999') AS state,
  first_yes_doy AS first_yes, NULLIF(numdays_since_prior_no, -9999) AS prior_no,
  last_yes_doy AS last_yes, NULLIF(numdays_until_next_no, -9999) AS next_no
  FROM raw WHERE first_yes_year = 2001 AND pheno_class_id IN (1, 7)
    AND state IN (SELECT concat('S', n_nationkey) FROM nation UNION ALL SELECT '-9999')
    AND first_yes_doy <= 33),
gh1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pheno_class_id, id
  ORDER BY first_yes, site_id, phenophase, prior_no NULLS LAST, common_name, elev NULLS LAST,
    last_yes, lat, lon, next_no NULLS LAST, state NULLS LAST) AS rn FROM gh) t WHERE rn = 1)
"""


@query(
    "g4_groundhog_records",
    GH_SQL + """SELECT site_id, id, phenophase, pheno_class_id, elev, state, first_yes, prior_no,
  last_yes, next_no FROM gh1""",
)
def groundhog_records(spark, sf_dir):
    rows = groundhog.first_records(groundhog.records(raw(spark, sf_dir, gaps=True), P))
    return rows.select(
        "site_id", "id", "phenophase", "pheno_class_id", "elev", "state", "first_yes", "prior_no",
        "last_yes", "next_no",
    )


@query(
    "g4_groundhog_summary",
    GH_SQL + """SELECT pheno_class_id, n_obs, n_indiv, n_first, n_missing_prior_no,
  round(n_missing_prior_no / n_first, 6) AS prop_missing_prior_no FROM
  (SELECT pheno_class_id, count(*) AS n_obs, count(DISTINCT id) AS n_indiv FROM gh GROUP BY 1) a
  JOIN (SELECT pheno_class_id, count(*) AS n_first, count(*) - count(prior_no)
    AS n_missing_prior_no FROM gh1 GROUP BY 1) b USING (pheno_class_id)""",
)
def groundhog_summary(spark, sf_dir):
    return groundhog.day_summary(groundhog.records(raw(spark, sf_dir, gaps=True), P))


@query(
    "g4_groundhog_classes",
    f"""WITH {ANOMALY_CELLS_SQL}, {CLASS_SQL} SELECT "class", count(*) AS n, CASE "class"
  WHEN 0 THEN 'Cool' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Warm' END AS label FROM classed
  WHERE "class" IS NOT NULL GROUP BY 1""",
)
def groundhog_classes(spark, sf_dir):
    return groundhog.class_frequency(anomaly_cells(spark, sf_dir))


CACHE_SQL = (
    chain(CLEAN_SQL, OBS_SQL, FILLED_SQL, gaps=True)
    + f"""SELECT {PLANT_COLUMNS.replace(" elev,", "")},
  coalesce(elev, round_even(s_acctbal, 0)) AS elev
  FROM filled LEFT JOIN supplier ON s_suppkey = site_id WHERE "year" BETWEEN 1995 AND 2000
  AND (species_id, pheno_class_id) IN (SELECT (species_id, pheno_class_id) FROM filled
    WHERE "year" = 2001)"""
)


@query("r1_refresh_prior", CACHE_SQL)
def refresh(spark, sf_dir):
    """Builds the cache as of two years earlier for some species, then tops it up."""
    path = scratch_dir(spark, "cache")
    source = raw(spark, sf_dir, gaps=True)
    shapes, elev = edges(spark, sf_dir), site_elevation(spark, sf_dir)
    cur = staged(anomalies.prepare(source, shapes, elev, P, years=[P.year]), "current")
    some = cur.where("species_id <= 4 AND pheno_class_id <= 5")
    then = P.with_(year=1999)
    refresh_prior(spark, source, path, some, shapes, elev, then, "first")
    return refresh_prior(spark, source, path, cur, shapes, elev, P, "second")


@query("r1_compacted_cache", CACHE_SQL)
def compacted(spark, sf_dir):
    """Five yearly refreshes, merged twice; what was replaced is deleted before reading."""
    path = scratch_dir(spark, "cache")
    source = raw(spark, sf_dir, gaps=True)
    shapes, elev = edges(spark, sf_dir), site_elevation(spark, sf_dir)
    cur = staged(anomalies.prepare(source, shapes, elev, P, years=[P.year]), "current")
    for year in range(P.year - 4, P.year + 1):
        some = cur if year > 1998 else cur.where("species_id <= 4")
        refresh_prior(spark, source, path, some, shapes, elev, P.with_(year=year), str(year))
        if year >= P.year - 1:
            compact_cache(spark, path, least=2)
    Batches(spark, path).vacuum(hours=0)
    return read_cache(spark, path)
