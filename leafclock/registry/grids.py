"""County tables and raster cells."""

from pyspark.sql import functions as F

from leafclock import schemas
from leafclock.operators import clean, county, raster
from leafclock.operators.zonal_store import zonal_years
from leafclock.params import BREAKS_GROUNDHOG
from leafclock.registry.base import query
from leafclock.registry.joins import ANOM_SQL
from leafclock.registry.standin import (
    ANOMALY_CELLS_SQL, CELLS_SQL, COARSE, COARSE_SQL, COUNTY_SQL, EDGE_SQL, GRID,
    NATION_YEARS_SQL, SITE_YEARS_SQL, YEARS, anomaly_cells, coarse_current, counties, edges,
    inside_sql, nation_years, site_years, table, yearly_cells,
)
from leafclock.sources.grids import read_cells, read_county_index, store_cells
from leafclock.sources.scratch import scratch_dir, staged
from leafclock.sources.sinks import write_table

KEYS = "STATEFP, COUNTYFP, state, county"
NATIONS = [f"S{i}_NATION_{i}_{i:02d}{i:03d}" for i in range(25)]


def _wide_sql(keys: str = KEYS, years=YEARS) -> str:
    cols = ", ".join(
        f'round(max(doy) FILTER ("year" = {y}), 6) AS doy_{y}' for y in years
    )
    return f"SELECT {keys}, {cols} FROM long GROUP BY {keys}"


@query("s2_read_county_index", f"WITH {SITE_YEARS_SQL} {_wide_sql()}")
def county_csv(spark, sf_dir):
    path = scratch_dir(spark, "county")
    wide = county.to_wide(site_years(spark, sf_dir), YEARS)
    write_table(wide, path, fmt="csv")
    return read_county_index(spark, path, YEARS)


@query(
    "s7_read_cells",
    f"""WITH {CELLS_SQL} SELECT "index", "year", "row", col, lon, lat,
  round("value", 6) AS "value" FROM cells""",
)
def cells_csv(spark, sf_dir):
    """Writes a folder of yearly files per index, each with one file the reader must skip."""
    columns, read = schemas.CELLS.fieldNames(), []
    for index in ("leaf", "bloom"):
        path = scratch_dir(spark, f"cells-{index}")
        own = yearly_cells(spark, sf_dir).where(F.col("index") == index)
        # The reader takes the year from the file name, so files are named here through
        # the partition folder and moved to it by name.
        named = F.concat(F.col("year").cast("string"), F.lit(f"_si-x_{index}.csv"))
        tagged = own.withColumn("name", named).select("name", *columns)
        ncep = own.where("year = 2001").withColumn("name", F.lit(f"ncep_20010101_si-x_{index}.csv"))
        write_named_csv(spark, tagged.unionByName(ncep.select("name", *columns)), path)
        read.append(read_cells(spark, path, index))
    return store_cells(read[0].unionByName(read[1]), scratch_dir(spark, "cells"))


def write_named_csv(spark, df, path):
    """One CSV file per value of ``name``: Spark writes a folder per value, and the
    part file of each folder gets that name."""
    (
        df.repartition("name").write.partitionBy("name").option("nullValue", "NA")
        .csv(f"{path}-parts", header=True)
    )
    fs_api = spark._jvm.org.apache.hadoop.fs
    root = fs_api.Path(f"{path}-parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_api.Path(path))
    for status in fs.globStatus(fs_api.Path(root, "name=*/part-*")):
        folder = status.getPath().getParent().getName()
        if not fs.rename(status.getPath(), fs_api.Path(path, folder.split("=", 1)[1])):
            raise OSError(f"a second file named {folder}")


@query(
    "f11_select_rename",
    f"""WITH {SITE_YEARS_SQL} SELECT concat(STATEFP, COUNTYFP) AS FIPS, STATEFP, COUNTYFP,
  round(max(doy) FILTER ("year" = 2000), 6) AS mean_2000,
  round(max(doy) FILTER ("year" = 2001), 6) AS mean_2001 FROM long GROUP BY {KEYS}""",
)
def select_rename(spark, sf_dir):
    wide = county.with_fips(county.to_wide(site_years(spark, sf_dir), YEARS))
    kept = clean.select_matching(
        wide, "^doy_", keep=("FIPS", "STATEFP", "COUNTYFP"),
        drop=[f"doy_{y}" for y in range(1995, 2000)], first=("FIPS",),
    )
    return clean.rename_matching(kept, "^doy_", "mean_")


@query(
    "f12_last_years",
    f"""WITH {SITE_YEARS_SQL} SELECT {KEYS}, "year", round(doy, 6) AS doy FROM long
  WHERE "year" BETWEEN 1998 AND 2001""",
)
def last(spark, sf_dir):
    return county.last_years(site_years(spark, sf_dir), 2001, 3)


@query(
    "p1_wide_to_long",
    f"""WITH {SITE_YEARS_SQL}, grid AS (SELECT * FROM (SELECT DISTINCT {KEYS} FROM long) k,
  (SELECT unnest(range(1995, 2002)) AS y) g)
SELECT {KEYS}, CAST(g.y AS INT) AS "year", round(l.doy, 6) AS doy
FROM grid g LEFT JOIN long l USING ({KEYS}) WHERE l."year" = g.y
UNION ALL SELECT {KEYS}, CAST(g.y AS INT), NULL FROM grid g
WHERE (COUNTYFP, y) NOT IN (SELECT (COUNTYFP, CAST("year" AS BIGINT)) FROM long)""",
)
def to_long(spark, sf_dir):
    return county.to_long(county.to_wide(site_years(spark, sf_dir), YEARS))


@query("p2_long_to_wide", f"WITH {SITE_YEARS_SQL} {_wide_sql()}")
def to_wide(spark, sf_dir):
    return county.to_wide(site_years(spark, sf_dir), YEARS)


_BY_YEAR = ", ".join(
    f"round(max(doy) FILTER (name_fips = '{n}'), 6) AS \"{n}\"" for n in NATIONS
)


@query(
    "p3_years_in_rows",
    f"""WITH {NATION_YEARS_SQL}, named AS (SELECT "year", doy,
  concat(state, '_', county, '_', STATEFP, COUNTYFP) AS name_fips FROM long)
SELECT "year", {_BY_YEAR} FROM named GROUP BY 1""",
)
def by_year(spark, sf_dir):
    return county.to_wide_by_year(county.with_fips(nation_years(spark, sf_dir)), NATIONS)


@query(
    "o2_order_counties",
    f"""WITH {SITE_YEARS_SQL} SELECT DISTINCT concat(STATEFP, COUNTYFP) AS FIPS,
  concat(state, '_', county, '_', STATEFP, COUNTYFP) AS name_FIPS FROM long ORDER BY 1""",
)
def ordered(spark, sf_dir):
    named = county.with_fips(site_years(spark, sf_dir))
    return named.select("FIPS", "name_FIPS").distinct().orderBy("FIPS")


# Every county with every year, as in the wide table: a year without a row is missing.
GRID_SQL = f"""counties AS (SELECT DISTINCT {KEYS} FROM long),
grid AS (SELECT c.*, CAST(y AS INT) AS "year", l.doy FROM counties c
  CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) r LEFT JOIN long l
  ON l.STATEFP = c.STATEFP AND l.COUNTYFP = c.COUNTYFP AND l."year" = r.y)"""
RANK_SQL = f"""{GRID_SQL},
cur AS (SELECT {KEYS}, doy AS currentyr FROM grid WHERE "year" = 2001),
ranks AS (SELECT {KEYS}, currentyr,
  CASE WHEN count(doy) = 6 THEN avg(doy) END AS mean40,
  CASE WHEN count(doy) = 6 THEN quantile_cont(doy, 0.5) END AS median40,
  count(*) FILTER (coalesce(doy < currentyr, TRUE)) AS n_earlier,
  count(*) FILTER (coalesce(doy > currentyr, TRUE)) AS n_later
  FROM grid JOIN cur USING ({KEYS}) WHERE "year" < 2001 GROUP BY {KEYS}, currentyr)"""
RANKS_OUT = f"""SELECT {KEYS}, round(currentyr, 6) AS currentyr, round(mean40, 6) AS mean40,
  round(median40, 6) AS median40, n_earlier, n_later FROM ranks"""
BASE_OUT = f"""SELECT {KEYS}, CASE WHEN count(doy) = 5 THEN round(avg(doy), 6) END AS baseline
  FROM grid WHERE "year" BETWEEN 1996 AND 2000 GROUP BY {KEYS}"""
# A third of the counties lacks a row for some year, the current one or an older one.
HOLES_SQL = SITE_YEARS_SQL.replace("long AS", "every AS", 1) + """,
long AS (SELECT * FROM every
  WHERE (CAST(COUNTYFP AS BIGINT) % 21) <> "year" - 1995 AND doy IS NOT NULL)"""


def _with_holes(spark, sf_dir):
    hole = F.col("COUNTYFP").cast("long") % 21 == F.col("year") - 1995
    return site_years(spark, sf_dir).where(~hole & F.col("doy").isNotNull())


@query("a13_rank_history", f"WITH {SITE_YEARS_SQL}, {RANK_SQL} {RANKS_OUT}")
def ranks(spark, sf_dir):
    return county.rank_against_history(site_years(spark, sf_dir), 2001, 6)


@query("a13_ranks_with_holes", f"WITH {HOLES_SQL}, {RANK_SQL} {RANKS_OUT}")
def ranks_with_holes(spark, sf_dir):
    return county.rank_against_history(_with_holes(spark, sf_dir), 2001, 6)


@query(
    "x13_return_interval",
    f"""WITH {SITE_YEARS_SQL}, {RANK_SQL} SELECT {KEYS},
  CASE WHEN n_later > 0 THEN round(7.0 / n_later, 6) END AS late,
  CASE WHEN n_earlier > 0 THEN round(7.0 / n_earlier, 6) END AS early,
  round(7.0 / (n_later + 1), 6) AS late_inclusive FROM ranks""",
)
def returns(spark, sf_dir):
    return county.rank_against_history(site_years(spark, sf_dir), 2001, 6).select(
        *county.COUNTY, county.return_interval("n_later", 6).alias("late"),
        county.return_interval("n_earlier", 6).alias("early"),
        county.return_interval("n_later", 6, inclusive=True).alias("late_inclusive"),
    )


@query("a14_baseline", f"WITH {SITE_YEARS_SQL}, {GRID_SQL} {BASE_OUT}")
def baseline(spark, sf_dir):
    return county.baseline(site_years(spark, sf_dir), 1996, 2000)


@query("a14_baseline_with_holes", f"WITH {HOLES_SQL}, {GRID_SQL} {BASE_OUT}")
def baseline_with_holes(spark, sf_dir):
    return county.baseline(_with_holes(spark, sf_dir), 1996, 2000)


@query(
    "x12_anomaly_with_holes",
    f"""WITH {HOLES_SQL}, {GRID_SQL}, wide AS (SELECT {KEYS},
    max(doy) FILTER ("year" = 2001) AS currentyr, CASE WHEN count(doy) FILTER
      ("year" BETWEEN 1996 AND 2000) = 5 THEN avg(doy) FILTER ("year" BETWEEN 1996 AND 2000) END
    AS baseline FROM grid GROUP BY {KEYS})
SELECT {KEYS}, round(currentyr, 6) AS currentyr, round(baseline, 6) AS baseline,
  round(currentyr - baseline, 6) AS anom FROM wide""",
)
def anomaly_with_holes(spark, sf_dir):
    return county.anomaly(_with_holes(spark, sf_dir), 2001, 1996, 2000)


def _anom(spark, sf_dir):
    long = nation_years(spark, sf_dir)
    return county.anomaly(long, 2001, 1996, 2000)


@query(
    "x12_anomaly",
    f"""WITH {ANOM_SQL} SELECT STATEFP, COUNTYFP, state, county, round(currentyr, 6) AS currentyr,
  round(baseline, 6) AS baseline, round(anom, 6) AS anom FROM anom""",
)
def anomaly(spark, sf_dir):
    return _anom(spark, sf_dir)


@query(
    "a15_anomaly_limits",
    f"""WITH {ANOM_SQL} SELECT round("limit", 6) AS "limit", CAST(CASE WHEN "limit" < 10 THEN 5
  ELSE floor("limit" / 10) * 10 END AS BIGINT) AS limit_round
  FROM (SELECT max(abs(anom)) AS "limit" FROM anom) t""",
)
def limits(spark, sf_dir):
    return county.anomaly_limits(_anom(spark, sf_dir))


# Areas in closed form, by the outline's and the hole's heights over x: each part is
# sign * integral of a + b * x, clipped to the cell, from x1 to x2.
COVERAGE_SQL = """part AS (SELECT * FROM (VALUES (0, 0.0, 0.3, 0.6, 4.0 / 3, 1), (0, 0.3, 1.0, 1.0, 0.0, 1),
  (0, 0.0, 1.0, 0.0, 0.0, -1), (1, 0.4, 0.5, -0.4, 2.0, -1), (1, 0.5, 0.6, 1.6, -2.0, -1),
  (1, 0.4, 0.6, 0.4, 0.0, 1)) v(ring, px1, px2, pa, pb, psign)),
lot AS (SELECT concat('S', n_nationkey) AS poly_id, n_nationkey, CAST(r AS INT) AS "row", CAST(c AS INT) AS col,
    -100.0 + c * 0.125 - (n_nationkey % 5 - 100) AS ca, 35.0 - (r + 1) * 0.125 - (n_nationkey // 5 + 30) AS cb
  FROM nation, (SELECT unnest(range(40)) AS r) a, (SELECT unnest(range(40)) AS c) b),
strip AS (SELECT poly_id, "row", col, CAST(greatest(px1, ca) AS DOUBLE) AS a, CAST(least(px2, ca + 0.125) AS DOUBLE) AS b,
    CAST(pa - cb AS DOUBLE) AS s0, CAST(pb AS DOUBLE) AS slope, psign FROM lot JOIN part
  ON (ring = 0 OR n_nationkey % 2 = 0) AND px1 < ca + 0.125 AND px2 > ca WHERE cb < 1 AND cb + 0.125 > 0),
ends AS (SELECT *, s0 + slope * a AS sa, s0 + slope * b AS sb FROM strip),
cov AS (SELECT poly_id, "row", col, sum(psign * CASE WHEN slope = 0 THEN (b - a) * least(greatest(s0, 0), 0.125)
    ELSE ((CASE WHEN sb <= 0 THEN 0 WHEN sb <= 0.125 THEN sb * sb / 2 ELSE 0.125 * sb - 0.0078125 END)
      - (CASE WHEN sa <= 0 THEN 0 WHEN sa <= 0.125 THEN sa * sa / 2 ELSE 0.125 * sa - 0.0078125 END)) / slope END)
    / 0.015625 AS frac FROM ends GROUP BY ALL HAVING frac > 1e-9)"""
ZONAL_SQL = """zonal AS (SELECT poly_id, "index", "year",
  sum("value" * frac) / sum(CASE WHEN "value" IS NOT NULL THEN frac END) AS mean,
  coalesce(sum(CASE WHEN "value" IS NOT NULL THEN frac END), 0) AS "count"
  FROM cells JOIN cov USING ("row", col) GROUP BY ALL)"""


@query("z1_coverage", f'WITH {COVERAGE_SQL} SELECT poly_id, "row", col, round(frac, 6) AS frac FROM cov')
def coverage(spark, sf_dir):
    return raster.coverage(edges(spark, sf_dir), GRID)


def zonal_of(spark, sf_dir, cells):
    cov = raster.coverage(edges(spark, sf_dir), GRID)
    return raster.zonal(cells, cov)


@query(
    "z2_zonal",
    f"""WITH {CELLS_SQL}, {COVERAGE_SQL}, {ZONAL_SQL} SELECT poly_id, "index", "year",
  round(mean, 6) AS mean, round("count", 6) AS "count" FROM zonal""",
)
def zonal(spark, sf_dir):
    return zonal_of(spark, sf_dir, yearly_cells(spark, sf_dir))


@query(
    "z2_zonal_incremental",
    f"""WITH {CELLS_SQL}, {COVERAGE_SQL}, {ZONAL_SQL} SELECT poly_id, "index", "year",
  round(mean, 6) AS mean, round("count", 6) AS "count" FROM zonal""",
)
def zonal_incremental(spark, sf_dir):
    """A store of zonal sums filled in two steps, and the current year computed anew."""
    path = scratch_dir(spark, "zonal-store")
    cells = store_cells(yearly_cells(spark, sf_dir), scratch_dir(spark, "cells"))
    cov = staged(raster.coverage(edges(spark, sf_dir), GRID), "coverage")
    keys = [(i, y) for i in ("leaf", "bloom") for y in range(1990, 2001)]
    zonal_years(cells, cov, path, [k for k in keys if k[1] < 1998])
    return zonal_years(cells, cov, path, keys, fresh=[("leaf", 2001), ("bloom", 2001)])


def _bilinear_sql(source: str, name: str, grid=COARSE, target=GRID) -> str:
    return f"""{name} AS (SELECT "index", "year", "row", col, lon, lat,
  sum(v * wx * wy) / sum(wx * wy) AS "value" FROM (
  SELECT s."index", s."year", t.*, s."value" AS v, 1 - abs(t.lon - s.lon) / {grid.res!r} AS wx,
    1 - abs(t.lat - s.lat) / {grid.res!r} AS wy
  FROM {source} s JOIN (SELECT r AS "row", c AS col, 
      CAST({target.x0!r} + (c + 0.5) * {target.res!r} AS DOUBLE) AS lon,
      CAST({target.y0!r} - (r + 0.5) * {target.res!r} AS DOUBLE) AS lat
    FROM (SELECT CAST(unnest(range({target.rows})) AS INT) AS r) a,
      (SELECT CAST(unnest(range({target.cols})) AS INT) AS c) b) t
  ON abs(t.lon - s.lon) < {grid.res!r} AND abs(t.lat - s.lat) < {grid.res!r}) w
  WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY ALL)"""


RESAMPLED_SQL = _bilinear_sql("coarse", "resampled")


@query(
    "z4_resample",
    f"""WITH {COARSE_SQL}, {RESAMPLED_SQL} SELECT "index", "year", "row", col, lon, lat,
  round("value", 6) AS "value" FROM resampled""",
)
def resample(spark, sf_dir):
    return raster.resample(coarse_current(spark, sf_dir), COARSE, GRID)


MIXED_SQL = f"""{CELLS_SQL.replace("cells AS", "all_cells AS", 1)}, {COARSE_SQL}, {RESAMPLED_SQL},
cells AS (SELECT "index", "year", "row", col, lon, lat, "value" FROM all_cells WHERE "year" < 2001
  UNION ALL SELECT "index", "year", "row", col, lon, lat, "value" FROM resampled)"""
MASK_SQL = """masked AS (SELECT z.poly_id, z."index", z."year",
  CASE WHEN z."year" = 2001 THEN z."count" / l."count" END AS frac, z."count",
  CASE WHEN z."year" <> 2001 OR z."count" / l."count" >= 0.9 THEN z.mean END AS mean
  FROM zonal z LEFT JOIN zonal l ON l.poly_id = z.poly_id AND l."index" = z."index"
    AND l."year" = 2000)"""


def mixed_cells(spark, sf_dir):
    """Prior years plus the resampled, incomplete current year."""
    prior = yearly_cells(spark, sf_dir).where("year < 2001")
    return prior.unionByName(raster.resample(coarse_current(spark, sf_dir), COARSE, GRID))


@query(
    "z3_mask_incomplete",
    f"""WITH {MIXED_SQL}, {COVERAGE_SQL}, {ZONAL_SQL}, {MASK_SQL} SELECT poly_id, "index", "year",
  round(mean, 6) AS mean, round("count", 6) AS "count", round(frac, 6) AS frac FROM masked""",
)
def mask(spark, sf_dir):
    return raster.mask_incomplete(zonal_of(spark, sf_dir, mixed_cells(spark, sf_dir)), 2001, 0.9)


CLASS_SQL = """classed AS (SELECT *, CASE WHEN "value" >= -500 AND "value" <= -20 THEN 0
  WHEN "value" > -20 AND "value" <= 20 THEN 1 WHEN "value" > 20 AND "value" <= 500 THEN 2 END
  AS "class" FROM acells)"""


@query(
    "z5_classify",
    f"""WITH {ANOMALY_CELLS_SQL}, {CLASS_SQL} SELECT "row", col, round("value", 6) AS "value",
  "class" FROM classed""",
)
def classify(spark, sf_dir):
    cells = raster.classify(anomaly_cells(spark, sf_dir), BREAKS_GROUNDHOG)
    return cells.select("row", "col", "value", "class")


@query(
    "z6_value_at",
    f"""WITH {CELLS_SQL} SELECT s_suppkey, "index", "year", round("value", 6) AS "value"
FROM (SELECT s_suppkey, -100 + ((s_suppkey * 61) % 100) * CAST(0.05 AS DOUBLE) AS px,
    30 + ((s_suppkey * 37) % 100) * CAST(0.05 AS DOUBLE) AS py FROM supplier) p
LEFT JOIN cells ON "row" = CAST(floor((35.0 - py) / 0.125) AS INT)
  AND col = CAST(floor((px + 100.0) / 0.125) AS INT)
WHERE floor((35.0 - py) / 0.125) BETWEEN 0 AND 39 AND floor((px + 100.0) / 0.125) BETWEEN 0 AND 39""",
)
def value_at(spark, sf_dir):
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.lit(-100) + ((s * 61) % 100) * 0.05).alias("lon"),
        (F.lit(30) + ((s * 37) % 100) * 0.05).alias("lat"),
    )
    out = raster.value_at(yearly_cells(spark, sf_dir), points, GRID)
    return out.select("s_suppkey", "index", "year", "value")


@query(
    "z7_frequency",
    f"""WITH {ANOMALY_CELLS_SQL}, {CLASS_SQL} SELECT "class", count(*) AS n FROM classed
  WHERE "class" IS NOT NULL GROUP BY 1""",
)
def frequency(spark, sf_dir):
    cells = raster.classify(anomaly_cells(spark, sf_dir), BREAKS_GROUNDHOG)
    return raster.frequency(cells, "class")


@query(
    "z8_class_label",
    f"""WITH {ANOMALY_CELLS_SQL}, {CLASS_SQL} SELECT "row", col, CASE "class" WHEN 0 THEN 'Cool'
  WHEN 1 THEN 'Normal' WHEN 2 THEN 'Warm' END AS label FROM classed""",
)
def label(spark, sf_dir):
    cells = raster.classify(anomaly_cells(spark, sf_dir), BREAKS_GROUNDHOG)
    return cells.select("row", "col", raster.class_label(F.col("class")).alias("label"))


@query(
    "z9_compare_grid",
    f"""WITH {ANOMALY_CELLS_SQL.replace("acells AS", "cells AS")}, {COVERAGE_SQL}, {ZONAL_SQL},
{COUNTY_SQL}, {ANOM_SQL}
SELECT poly_id, 'leaf' AS "index", 2001 AS "year", round(anom, 6) AS anom,
  round(z.mean, 6) AS grid_anom, round(anom - z.mean, 6) AS difference
FROM county JOIN anom USING (STATEFP, COUNTYFP) LEFT JOIN zonal z USING (poly_id)""",
)
def compare(spark, sf_dir):
    cells = anomaly_cells(spark, sf_dir)
    cov = raster.coverage(edges(spark, sf_dir), GRID)
    own = county.county_layer(counties(spark, sf_dir), _anom(spark, sf_dir)).select(
        "poly_id", F.lit("leaf").alias("index"), F.lit(2001).alias("year"), "anom"
    )
    return raster.compare_grid(own, cells, cov)
