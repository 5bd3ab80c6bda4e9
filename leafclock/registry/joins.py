"""Lookups, point in polygon, neighbour pools and the other joins."""

from pyspark.sql import functions as F

from leafclock.functions import labels
from leafclock.operators import anomaly, clean, fill, locate, pool, raster, state
from leafclock.registry.base import query, rounded_columns
from leafclock.registry.standin import (
    BASE, CLEAN_SQL, COUNTY_SQL, EDGE_SQL, GRID, NATION_YEARS_SQL, OBS_SQL, P, POOL,
    PLANT_COLUMNS, SITE_SQL, VERTEX_SQL, chain, class_table, counties, cur_prior, edges,
    inside_sql, lambert_sql, nation_years, observations, raw, site_elevation, table, vertices,
)
from leafclock.operators import county
from leafclock.operators.pool import pool_index
from leafclock.sources import regions
from leafclock.sources.scratch import scratch_dir, staged

GAPS = chain(CLEAN_SQL, OBS_SQL, gaps=True)
FILLED_SQL = f"""{EDGE_SQL},
need AS (SELECT DISTINCT site_id, lon AS x, lat AS y FROM obs WHERE state IS NULL),
{inside_sql("need", "site_id")},
located1 AS (SELECT site_id, min(poly_id) AS state_new FROM located GROUP BY site_id),
filled AS (SELECT * FROM (SELECT obs.* REPLACE (coalesce(state, state_new) AS state)
  FROM obs LEFT JOIN located1 USING (site_id)) t
  WHERE state IN (SELECT concat('S', n_nationkey) FROM nation))"""


def filled_obs(spark, sf_dir):
    obs = observations(spark, sf_dir, gaps=True)
    return fill.fill_state(obs, edges(spark, sf_dir), P)


@query("s8_polygon_edges", f"WITH {EDGE_SQL} SELECT * FROM edge")
def polygon_edges_(spark, sf_dir):
    return edges(spark, sf_dir)


@query("s8_polygon_vertices", f"WITH {VERTEX_SQL} SELECT * EXCLUDE (n_nationkey) FROM vertex")
def polygon_vertices(spark, sf_dir):
    return vertices(spark, sf_dir)


@query("s8_region_files", f"WITH {VERTEX_SQL} SELECT * EXCLUDE (n_nationkey) FROM vertex")
def region_files(spark, sf_dir):
    path = scratch_dir(spark, "regions")
    regions.write_regions(regions.regions_of(vertices(spark, sf_dir)), path)
    return regions.region_vertices(regions.read_regions(spark, path, records=4), "poly_id")


@query(
    "j1_locate_points",
    f"""WITH {EDGE_SQL},
pts AS (SELECT DISTINCT -100 + (l_orderkey * 61 % 4999) * CAST(0.001 AS DOUBLE) AS x,
  30 + (l_partkey * 37 % 4999) * CAST(0.001 AS DOUBLE) AS y FROM lineitem),
{inside_sql("pts", "x AS px, y AS py").replace("BY x AS px, y AS py, x", "BY x")}
SELECT round(x, 6) AS x, round(y, 6) AS y, poly_id FROM located""",
)
def locate_(spark, sf_dir):
    pts = table(spark, sf_dir, "lineitem").select(
        (F.lit(-100) + (F.col("l_orderkey") * 61 % 4999) * 0.001).alias("x"),
        (F.lit(30) + (F.col("l_partkey") * 37 % 4999) * 0.001).alias("y"),
    )
    return locate.locate_points(pts, edges(spark, sf_dir))


@query("j2_fill_state", f"{GAPS}, {FILLED_SQL} SELECT {PLANT_COLUMNS} FROM filled")
def fill_state_(spark, sf_dir):
    return filled_obs(spark, sf_dir)


@query(
    "j3_fill_elevation",
    f"""{GAPS} SELECT {PLANT_COLUMNS.replace(" elev,", "")},
  coalesce(elev, round_even(s_acctbal, 0)) AS elev
  FROM obs LEFT JOIN supplier ON s_suppkey = site_id""",
)
def fill_elevation_(spark, sf_dir):
    obs = observations(spark, sf_dir, gaps=True)
    return fill.fill_elevation(obs, site_elevation(spark, sf_dir))


@query(
    "j4_replace_elevation",
    f"""{GAPS} SELECT {PLANT_COLUMNS.replace(" elev,", "")},
  round_even(s_acctbal + 0.5, 0) AS elev FROM obs LEFT JOIN supplier ON s_suppkey = site_id""",
)
def replace_elevation(spark, sf_dir):
    shifted = site_elevation(spark, sf_dir).withColumn("elevation", F.col("elevation") + 0.5)
    return fill.fill_elevation(observations(spark, sf_dir, gaps=True), shifted, overwrite=True)


DEM_SQL = """dem AS (SELECT CAST(l_partkey % 40 AS INT) AS "row",
  CAST(l_orderkey % 40 AS INT) AS col, sum(CAST(l_quantity AS INT)) * 1.0 / count(*) AS elevation
  FROM lineitem GROUP BY 1, 2)"""


@query(
    "j5_elevation_at",
    f"""WITH {SITE_SQL}, {DEM_SQL}
SELECT sid AS site_id, round(elevation, 6) AS elevation FROM site LEFT JOIN dem
  ON "row" = CAST(floor((35.0 - slat) / 0.125) AS INT)
  AND col = CAST(floor((slon + 100.0) / 0.125) AS INT)""",
)
def elevation_at_(spark, sf_dir):
    dem = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_partkey") % 40).cast("int").alias("row"),
            (F.col("l_orderkey") % 40).cast("int").alias("col"),
        )
        .agg((F.sum(F.col("l_quantity").cast("int")) / F.count(F.lit(1))).alias("elevation"))
    )
    s = F.col("s_suppkey")
    sites = table(spark, sf_dir, "supplier").select(
        s.alias("site_id"), (F.lit(30) + ((s * 37) % 100) * 0.05).alias("lat"),
        (F.lit(-100) + ((s * 61) % 100) * 0.05).alias("lon"),
    )
    return raster.elevation_at(sites, dem, GRID)


SIZES = """site_id, id, pheno_class_id, first_yes, n_obs_r, n_yrs_r"""


@query(
    "j6_neighbour_pool",
    POOL + f"""SELECT {SIZES}, "min", round(qearly, 6) AS qearly, round(q25, 6) AS q25,
  round(q75, 6) AS q75 FROM sized""",
)
def neighbour(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    sized = pool.pool_sizes(cur, prior, P, individuals=False)
    return sized.select(
        "site_id", "id", "pheno_class_id", "first_yes", "n_obs_r", "n_yrs_r", "min", "qearly",
        "q25", "q75",
    )


@query(
    "geodesic_distance",
    f"""WITH {SITE_SQL} SELECT n1, n2, round(km, 6) AS km FROM {lambert_sql(
        "lat1", "lon1", "lat2", "lon2",
        '''(SELECT s_suppkey AS n1, s_nationkey AS n2, slat AS lat1, slon AS lon1,
          30.0 + s_nationkey // 5 AS lat2, -100.0 + s_nationkey % 5 AS lon2
          FROM supplier JOIN site ON sid = s_suppkey) e''')} g""",
)
def distances(spark, sf_dir):
    from leafclock.functions.geodesy import distance_km

    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    lat, lon = F.lit(30) + ((s * 37) % 100) * 0.05, F.lit(-100) + ((s * 61) % 100) * 0.05
    to_lat, to_lon = 30.0 + F.floor(n / 5), -100.0 + n % 5
    return table(spark, sf_dir, "supplier").select(
        s.alias("n1"), n.alias("n2"), distance_km(lat, lon, to_lat, to_lon).alias("km")
    )


@query(
    "j7_restrict_to_current",
    chain(CLEAN_SQL, OBS_SQL) + f"""SELECT {PLANT_COLUMNS} FROM obs WHERE "year" < 2001
  AND (species_id, pheno_class_id, state) IN (SELECT (species_id, pheno_class_id, state)
    FROM obs WHERE "year" = 2001)""",
)
def semi(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return pool.restrict_to_current(
        clean.prior_of(obs, P), clean.current_of(obs, P), ["species_id", "pheno_class_id", "state"]
    )


@query(
    "j8_missing_species",
    chain(CLEAN_SQL, OBS_SQL) + """SELECT DISTINCT species_id, pheno_class_id FROM obs
  WHERE "year" = 2001 EXCEPT SELECT DISTINCT species_id, pheno_class_id FROM obs
  WHERE "year" < 2001 AND (species_id + pheno_class_id) % 3 <> 0""",
)
def anti(spark, sf_dir):
    obs = observations(spark, sf_dir)
    cached = clean.prior_of(obs, P).where("(species_id + pheno_class_id) % 3 <> 0")
    return pool.missing_keys(clean.current_of(obs, P), cached, ["species_id", "pheno_class_id"])


@query(
    "j9_attach_distribution",
    BASE + """, d AS (SELECT state, common_name, pheno_class_id, min(first_yes) AS "min",
  quantile_cont(first_yes, 0.05) AS qearly FROM prior GROUP BY ALL HAVING count(*) > 3)
SELECT site_id, id, pheno_class_id, first_yes, "min", round(qearly, 6) AS qearly
FROM cur JOIN d USING (state, common_name, pheno_class_id)""",
)
def attach(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    keys = ["state", "common_name", "pheno_class_id"]
    sizes = prior.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    dist = anomaly.distribution(prior.join(sizes, keys, "left_semi"), keys)
    return anomaly.attach_distribution(cur, dist, keys).select(
        "site_id", "id", "pheno_class_id", "first_yes", "min", "qearly"
    )


def compared(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    return anomaly.compare_with_pool(cur, prior, P)


def flags_and_prior(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    flags = anomaly.flagged_rows(anomaly.compare_with_pool(cur, prior, P))
    return staged(flags, "flags"), prior


@query(
    "j10_attach_details",
    POOL + """SELECT f.indiv, f.state, f.pheno_class_id, f.first_yes, f."min", f.early, f.outlier,
  s.common_name, s.id, s.lat, s.lon, s.elev, s.func_type, s.n_obs_r, s.n_yrs_r
FROM flags f LEFT JOIN sized s ON concat(s.common_name, '_', s.id) = f.indiv
  AND s.pheno_class_id = f.pheno_class_id""",
)
def details(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    # Read on both sides of the join.
    sized = staged(pool.pool_sizes(cur, prior, P, individuals=False), "sized")
    flags = anomaly.flagged_rows(
        anomaly.flag(anomaly.with_thresholds(clean.sufficient(sized, P.min_obs, P.min_yrs)))
        .withColumn("indiv", labels.indiv())
    )
    return anomaly.attach_details(flags, sized, P)


@query(
    "j11_early_points",
    POOL + """SELECT f.indiv, f.pheno_class_id, f.site_id, s.lon, s.lat FROM flags f
LEFT JOIN (SELECT DISTINCT site_id, lon, lat FROM cur) s USING (site_id) WHERE f.early = 1""",
)
def points(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    flags = anomaly.flagged_rows(anomaly.compare_with_pool(cur, prior, P))
    return anomaly.early_points(flags, cur).select(
        "indiv", "pheno_class_id", "site_id", "lon", "lat"
    )


ANOM_SQL = f"""{NATION_YEARS_SQL},
anom AS (SELECT *, currentyr - baseline AS anom FROM (SELECT STATEFP, COUNTYFP, state, county,
  max(doy) FILTER ("year" = 2001) AS currentyr, CASE WHEN count(doy) FILTER
    ("year" BETWEEN 1996 AND 2000) = 5 THEN avg(doy) FILTER ("year" BETWEEN 1996 AND 2000) END
  AS baseline FROM long GROUP BY ALL) w)"""


@query(
    "j12_county_layer",
    f"""WITH {COUNTY_SQL}, {ANOM_SQL} SELECT c.*, round(anom, 6) AS anom FROM county c
  JOIN anom USING (STATEFP, COUNTYFP)""".replace("c.*", "c.poly_id, c.STATEFP, c.COUNTYFP, "
    "c.state, c.county"),
)
def layer(spark, sf_dir):
    long = nation_years(spark, sf_dir)
    anom = county.anomaly(long, 2001, 1996, 2000)
    return county.county_layer(counties(spark, sf_dir), anom)


@query(
    "j14_panel_pool",
    POOL + """SELECT f.common_name, f.func_type, f.pheno_class_id, q.p_site AS site_id,
  q.p_lat AS lat, q.p_lon AS lon, q.p_elev AS elev, q.p_state AS state, q.py AS "year",
  q.pf AS first_yes, f.indiv, f.panel FROM flags f JOIN pool q USING (id, pheno_class_id)""",
    rounds=False,
)
def panels(spark, sf_dir):
    flags, prior = flags_and_prior(spark, sf_dir)
    return anomaly.panel_pool(flags, prior, P, shown=rounded_columns(prior))


PANEL_SQL = POOL + """SELECT f.common_name, f.func_type, f.pheno_class_id, q.p_site AS site_id,
  q.p_lat AS lat, q.p_lon AS lon, q.p_elev AS elev, q.p_state AS state, q.py AS "year",
  q.pf AS first_yes, f.indiv, f.panel FROM flags f JOIN pool q USING (id, pheno_class_id)"""


@query("j14_stored_panels", PANEL_SQL, rounds=False)
def stored_panels(spark, sf_dir):
    """All panels out of pools that are stored as cells and places."""
    flags, prior = flags_and_prior(spark, sf_dir)
    return anomaly.read_panels(pool_index(flags, prior, P), flags, prior, P, shown=rounded_columns(prior))


@query("j14_one_panel", PANEL_SQL + " WHERE f.panel = (SELECT min(panel) FROM flags)", rounds=False)
def one_panel(spark, sf_dir):
    """The first panel, read out of the stored pools of all."""
    flags, prior = flags_and_prior(spark, sf_dir)
    first = flags.agg(F.min("panel")).first()[0]
    return anomaly.read_panels(
        pool_index(flags, prior, P), flags, prior, P, panels=[first], shown=rounded_columns(prior))


STATE_SQL = """skept AS (SELECT * FROM prior p JOIN (
    SELECT state, common_name, pheno_class_id, count(*) AS s_obs, count(DISTINCT "year") AS s_yrs
    FROM prior WHERE (state, common_name, pheno_class_id) IN
      (SELECT (state, common_name, pheno_class_id) FROM cur)
    GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT "year") >= 5) k
  USING (state, common_name, pheno_class_id)),
sdist AS (SELECT *, CASE WHEN q25 - 1.5 * (q75 - q25) < "min" THEN "min"
    ELSE q25 - 1.5 * (q75 - q25) END AS outlier_threshold FROM (
  SELECT state, common_name, pheno_class_id, min(first_yes) AS "min",
    quantile_cont(first_yes, 0.05) AS qearly, quantile_cont(first_yes, 0.25) AS q25,
    quantile_cont(first_yes, 0.75) AS q75 FROM skept GROUP BY ALL) t),
scompared AS (SELECT *, CAST(first_yes < qearly AS INT) AS early,
    CAST(first_yes < outlier_threshold AS INT) AS outlier
  FROM cur JOIN sdist USING (state, common_name, pheno_class_id)),
sflags AS (SELECT *, concat(common_name, ' (', state, ')') AS panel,
    CASE WHEN outlier = 1 THEN 'Outlier' ELSE 'Early' END AS eo
  FROM scompared WHERE early = 1 OR outlier = 1)"""
STATE = BASE + ", " + STATE_SQL


@query(
    "j15_state_panels",
    STATE + """, panels AS (SELECT DISTINCT state, common_name, pheno_class_id, panel FROM sflags),
rows_ AS (SELECT r.common_name, r.state, r.func_type, r.pheno_class_id, r."year", r.first_yes,
    s.panel, 'All' AS "group" FROM prior r JOIN panels s USING (common_name, pheno_class_id)
  UNION ALL SELECT r.common_name, r.state, r.func_type, r.pheno_class_id, r."year", r.first_yes,
    s.panel, 'State' FROM prior r JOIN panels s USING (state, common_name, pheno_class_id))
SELECT *, concat(state, '_', common_name) AS state_spp,
  concat(state, '_', common_name, '_', pheno_class_id) AS state_spp_ph FROM rows_""",
)
def state_panels_(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    flags = state.flagged_in_state(state.compare_in_state(cur, prior, P))
    return state.state_panels(prior, flags, P)


@query(
    "u2_stack_panels",
    STATE + """, panels AS (SELECT DISTINCT state, common_name, pheno_class_id, panel FROM sflags)
SELECT 'All' AS "group", panel, count(*) AS n FROM prior r
  JOIN panels s USING (common_name, pheno_class_id) GROUP BY panel
UNION ALL SELECT 'State', panel, count(*) FROM prior r
  JOIN panels s USING (state, common_name, pheno_class_id) GROUP BY panel""",
)
def stack_panels(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    flags = state.flagged_in_state(state.compare_in_state(cur, prior, P))
    days = state.state_panel_days(prior, flags, P)
    return days.groupBy("group", "panel").agg(F.sum("n").alias("n"))


@query(
    "j15_state_panel_days",
    STATE + """, panels AS (SELECT DISTINCT state, common_name, pheno_class_id, panel FROM sflags),
both_ AS (SELECT 'All' AS "group", s.panel, r.pheno_class_id, r.first_yes FROM prior r
  JOIN panels s USING (common_name, pheno_class_id)
  UNION ALL SELECT 'State', s.panel, r.pheno_class_id, r.first_yes FROM prior r
  JOIN panels s USING (state, common_name, pheno_class_id))
SELECT *, count(*) AS n FROM both_ GROUP BY ALL""",
)
def state_panel_days(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    flags = state.flagged_in_state(state.compare_in_state(cur, prior, P))
    days = state.state_panel_days(prior, flags, P)
    return days.groupBy("group", "panel", "pheno_class_id", "first_yes").agg(F.sum("n").alias("n"))


@query(
    "j16_class_labels",
    chain(CLEAN_SQL, OBS_SQL) + """SELECT site_id, id, o.pheno_class_id, "year",
  concat('OPEN flowers ', pheno_class_id) AS class_name,
  concat('Open flowers ', pheno_class_id) AS title FROM obs o""",
)
def class_names(spark, sf_dir):
    obs = observations(spark, sf_dir).select("site_id", "id", "pheno_class_id", "year")
    return anomaly.class_labels(obs, class_table(spark, sf_dir))
