"""The driver's tables read as observations, grids and regions, in Spark and in SQL.

A line item stands for one raw record: supplier = site, part = individual, part
type = species, line number = phase class, ship date = first day seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafclock.functions.geodesy import WGS84_A, WGS84_F
from leafclock.operators.clean import clean_observations
from leafclock.operators.raster import CellGrid
from leafclock.params import AUTUMN, Params
from leafclock.plans.anomalies import split
from leafclock.sources.grids import polygon_edges

STATES = tuple(f"S{i}" for i in range(25))
P = Params(
    year=2001,
    first_prior_year=1995,
    min_obs=20,
    min_yrs=5,
    pheno_class_ids=tuple(range(1, 8)),
    allowed_states=STATES,
)
# The stand-in holds a second phenophase and days out of season: both are out of scope.
P_AUTUMN = P.with_(
    phase_key="phenophase", phenophase_ids=(498,), period=("07-01", "12-31"), pheno_class_ids=(),
    func_types=AUTUMN.func_types,
)
P_ANIMALS = P.with_(phase_key="phenophase_category", unit="site_id")

# Fixed values of the stand-in: species number and functional type of a part type.
SPECIES_IDS = {
    "ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6,
}
FUNC_TYPES = {
    1: "Deciduous broadleaf", 2: "Drought deciduous broadleaf", 3: "Evergreen conifer",
    4: "Forb", 5: "Graminoid", 6: "Cactus",
}
CATEGORIES = {
    1: "Activity", 2: "Activity", 3: "Activity", 4: "Reproduction", 5: "Reproduction",
    6: "Development", 7: "Method",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, mapping: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


# Expressions that read the same in both engines; {even} is round-half-even.
_RAW = """
    l_suppkey AS site_id,
    30 + ((l_suppkey * 37) % 100) * CAST(0.05 AS DOUBLE) AS latitude,
    -100 + ((l_suppkey * 61) % 100) * CAST(0.05 AS DOUBLE) AS longitude,
    {elev} AS elevation_in_meters,
    {state} AS state,
    p_type AS common_name,
    CAST({species} AS BIGINT) AS species_id,
    CAST({species} AS INT) AS class_id,
    {func} AS species_functional_type,
    l_partkey AS individual_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 498 ELSE 471 END AS phenophase_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'Colored leaves' ELSE 'Falling leaves' END
      AS phenophase_description,
    {category} AS phenophase_category,
    l_linenumber AS pheno_class_id,
    CAST(year(l_shipdate) AS INT) AS first_yes_year,
    CAST(dayofyear(l_shipdate) AS INT) AS first_yes_doy,
    CASE WHEN l_quantity = 50 THEN -9999 ELSE CAST(l_quantity AS INT) END
      AS numdays_since_prior_no,
    CASE WHEN l_returnflag = 'R' THEN 'MultiObserver' ELSE '-9999' END
      AS observed_status_conflict_flag,
    CAST(dayofyear(l_shipdate) AS INT) + l_linenumber AS last_yes_doy,
    CASE WHEN l_linestatus = 'F' THEN -9999 ELSE l_linenumber * 2 END AS numdays_until_next_no
"""
_PLAIN = {"elev": "{even}(s_acctbal, 0)", "state": "concat('S', s_nationkey)"}
_GAPS = {
    "elev": "CASE WHEN s_suppkey % 11 = 3 THEN CAST(-9999 AS DOUBLE) ELSE {even}(s_acctbal, 0) END",
    "state": "CASE WHEN s_suppkey % 13 = 5 THEN '-9999' WHEN s_suppkey % 13 = 6 THEN '' "
    "ELSE concat('S', s_nationkey) END",
}


def _raw_columns(gaps: bool, even: str) -> str:
    parts = {k: v.replace("{even}", even) for k, v in (_GAPS if gaps else _PLAIN).items()}
    species = _case("p_type", SPECIES_IDS)
    return _RAW.format(
        **parts,
        species=species,
        func=_case(f"({species})", FUNC_TYPES),
        category=_case("l_linenumber", CATEGORIES),
    )


def raw(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Raw records; with ``gaps`` some sites lack state or elevation.

    Individuals grow with the records and their files compress well: by file size Spark would still
    broadcast a table that fills the driver's memory.
    """
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    # One projection of SQL expressions shared with the comparison SQL.
    return joined.selectExpr(*_split_columns(_raw_columns(gaps, "bround")))


def _split_columns(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def observations(spark, sf_dir, p: Params = P, gaps: bool = False, kind: str = "plants"):
    return clean_observations(raw(spark, sf_dir, gaps), p, kind)


def cur_prior(spark, sf_dir, p: Params = P, kind: str = "plants"):
    return split(observations(spark, sf_dir, p, kind=kind), p)


def site_elevation(spark, sf_dir) -> DataFrame:
    """Looked-up elevation per site, deliberately unrounded."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_acctbal").alias("elevation")
    )


def species_table(spark, sf_dir) -> DataFrame:
    """Species dimension from the part types in use."""
    sid = F.expr(_case("p_type", SPECIES_IDS))
    return (
        table(spark, sf_dir, "part")
        .select(
            sid.cast("long").alias("species_id"), F.col("p_type").alias("common_name"),
            sid.cast("int").alias("class_id"),
            F.when(sid > 3, "Animalia").otherwise("Plantae").alias("kingdom"),
        )
        .distinct()
    )


def phenophase_table(spark, sf_dir) -> DataFrame:
    """Phenophase dimension from the line numbers in use."""
    n = F.col("l_linenumber")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            (n + 400).alias("phenophase_id"),
            F.concat(F.lit("PHASE "), n.cast("string")).alias("phenophase_name"),
            F.when(n % 2 == 1, "Leaves").otherwise("Flowers").alias("phenophase_category"),
            (n + 10).alias("pheno_class_id"),
        )
        .distinct()
    )


def class_table(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return (
        table(spark, sf_dir, "lineitem")
        .select(n.alias("id"), F.concat(F.lit("OPEN flowers "), n.cast("string")).alias("name"))
        .distinct()
    )


# Outline of a region within its unit square, and the hole of every second one.
_OUTLINE = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.3, 1.0), (0.0, 0.6))
_HOLE = ((0.4, 0.4), (0.6, 0.4), (0.5, 0.6))
_VERTEX_VALUES = ", ".join(
    f"({ring}, {seq}, CAST({dx} AS DOUBLE), CAST({dy} AS DOUBLE))"
    for ring, points in ((0, _OUTLINE), (1, _HOLE))
    for seq, (dx, dy) in enumerate(points)
)


def vertices(spark, sf_dir) -> DataFrame:
    """Region outlines: one unit square per nation, a corner cut off, some with holes."""
    n = F.col("n_nationkey")
    shape = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(ring).alias("ring_id"), F.lit(seq).alias("seq"),
                    F.lit(dx).alias("dx"), F.lit(dy).alias("dy"),
                )
                for ring, points in ((0, _OUTLINE), (1, _HOLE))
                for seq, (dx, dy) in enumerate(points)
            ]
        )
    )
    return (
        table(spark, sf_dir, "nation")
        .select("n_nationkey", shape.alias("v"))
        .where((F.col("v.ring_id") == 0) | (n % 2 == 0))
        .select(
            F.concat(F.lit("S"), n.cast("string")).alias("poly_id"), "v.ring_id", "v.seq",
            ((n % 5 - 100) + F.col("v.dx")).alias("x"),
            ((F.floor(n / 5) + 30) + F.col("v.dy")).alias("y"),
        )
    )


def edges(spark, sf_dir) -> DataFrame:
    return polygon_edges(vertices(spark, sf_dir))


def counties(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("S"), n).alias("poly_id"),
        F.lpad(n, 2, "0").alias("STATEFP"), F.lpad(n, 3, "0").alias("COUNTYFP"),
        F.concat(F.lit("S"), n).alias("state"), F.col("n_name").alias("county"),
    )


GRID = CellGrid(-100.0, 35.0, 0.125, 40, 40)
COARSE = CellGrid(-100.0, 35.0, 0.15625, 32, 32)


def _cells(spark, sf_dir, grid: CellGrid, value) -> DataFrame:
    row, col = (F.col(c) % n for c, n in (("l_partkey", grid.rows), ("l_orderkey", grid.cols)))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.when(F.col("l_linenumber") % 2 == 1, "leaf").otherwise("bloom").alias("index"),
            F.year("l_shipdate").alias("year"),
            row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("v"),
        )
        .groupBy("index", "year", "row", "col")
        .agg(F.avg("v").alias("value"))
        .select(
            "index", "year", "row", "col", grid.lon(F.col("col")).alias("lon"),
            grid.lat(F.col("row")).alias("lat"), "value",
        )
    )


def yearly_cells(spark, sf_dir) -> DataFrame:
    """Day-of-year grids of all years, one value per cell."""
    return _cells(spark, sf_dir, GRID, F.dayofyear("l_shipdate"))


def coarse_current(spark, sf_dir) -> DataFrame:
    """Current year on a coarser grid, with a patch not reached yet."""
    cells = _cells(spark, sf_dir, COARSE, F.dayofyear("l_shipdate")).where(
        F.col("year") == P.year
    )
    return cells.where(~(F.col("row").between(8, 15) & F.col("col").between(16, 23)))


def anomaly_cells(spark, sf_dir) -> DataFrame:
    """Temperature-sum anomaly grid of the current year, within +-500."""
    cells = _cells(spark, sf_dir, GRID, F.col("l_quantity"))
    value = (F.col("value") - 25.5) * 20
    return cells.where((F.col("year") == P.year) & (F.col("index") == "leaf")).withColumn(
        "value", value
    )


def site_years(spark, sf_dir) -> DataFrame:
    """Long county table: supplier x year mean day, some years missing."""
    doy = F.when(F.col("n") % 7 == 0, F.lit(None).cast("double")).otherwise(
        F.col("total") / F.col("n")
    )
    key = F.col("s_suppkey").cast("string")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.dayofyear("l_shipdate")).alias("total"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("STATEFP"),
            F.lpad(key, 9, "0").alias("COUNTYFP"),
            F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("state"),
            F.col("s_name").alias("county"), "year", doy.alias("doy"),
        )
    )


def nation_years(spark, sf_dir) -> DataFrame:
    """Long county table with one county per nation."""
    n = F.col("s_nationkey").cast("string")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.year("l_shipdate").alias("year"))
        .agg((F.sum(F.dayofyear("l_shipdate")) / F.count(F.lit(1))).alias("doy"))
        .select(
            F.lpad(n, 2, "0").alias("STATEFP"), F.lpad(n, 3, "0").alias("COUNTYFP"),
            F.concat(F.lit("S"), n).alias("state"),
            F.concat(F.lit("NATION_"), n).alias("county"), "year", "doy",
        )
    )


# --- the same in SQL -------------------------------------------------------

YEARS = range(1995, 2002)


def raw_sql(gaps: bool = False) -> str:
    return f"""raw AS (SELECT {_raw_columns(gaps, "round_even")}
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


PROJECTED_SQL = """proj AS (SELECT site_id, latitude AS lat, longitude AS lon,
  NULLIF(elevation_in_meters, -9999) AS elev, NULLIF(NULLIF(state, '-9999'), '') AS state,
  common_name, species_id, species_functional_type AS func_type, individual_id AS id,
  phenophase_id, phenophase_description AS phenophase, phenophase_category, pheno_class_id,
  first_yes_year AS "year", first_yes_doy AS first_yes,
  NULLIF(numdays_since_prior_no, -9999) AS prior_no,
  NULLIF(observed_status_conflict_flag, '-9999') AS flag FROM raw)"""
CLEAN_SQL = """clean AS (SELECT * EXCLUDE (flag) FROM proj WHERE flag IS NULL AND prior_no <= 30)"""

PLANT_COLUMNS = (
    'site_id, lat, lon, elev, state, common_name, species_id, func_type, id, phenophase, '
    'pheno_class_id, "year", first_yes, prior_no'
)
AUTUMN_COLUMNS = PLANT_COLUMNS.replace("phenophase, pheno_class_id", "phenophase_id, phenophase")
ANIMAL_COLUMNS = PLANT_COLUMNS.replace(" id,", " phenophase_category,")


def first_sql(columns: str, keys: str, source: str = "clean", name: str = "obs") -> str:
    """First record per key; every other column breaks ties."""
    ties = [c.strip().strip('"') for c in columns.split(",")]
    lead = ["site_id", "phenophase", "prior_no"]
    rest = sorted(c for c in ties if c not in lead)
    used = [k.strip().strip('"') for k in keys.split(",")] + ["first_yes"]
    order = ", ".join(f'"{c}" NULLS LAST' for c in lead + rest if c not in used)
    return f"""{name} AS (SELECT {columns} FROM (SELECT {columns}, ROW_NUMBER() OVER (
  PARTITION BY {keys} ORDER BY first_yes NULLS LAST, {order}) AS rn FROM {source}) q
  WHERE rn = 1)"""


OBS_SQL = first_sql(PLANT_COLUMNS, 'id, pheno_class_id, "year"')


def split_sql(phase: str = "pheno_class_id") -> str:
    return f"""cur AS (SELECT * FROM obs WHERE "year" = 2001),
prior AS (SELECT * FROM obs WHERE "year" BETWEEN 1995 AND 2000
  AND (common_name, {phase}) IN (SELECT (common_name, {phase}) FROM cur))"""


def chain(*ctes: str, gaps: bool = False) -> str:
    return "WITH " + ",\n".join([raw_sql(gaps), PROJECTED_SQL, *ctes]) + "\n"


BASE = chain(CLEAN_SQL, OBS_SQL, split_sql())


def lambert_sql(lat1: str, lon1: str, lat2: str, lon2: str, source: str) -> str:
    """Subquery that adds the ellipsoid distance ``km`` to ``source``."""
    f, a = repr(WGS84_F), repr(WGS84_A)
    return f"""(SELECT *, CASE WHEN s = 0 THEN 0 ELSE {a} * (s - {f} / 2 * (
    (s - sin(s)) * pow(sin((b1 + b2) / 2) * cos((b2 - b1) / 2) / cos(s / 2), 2) +
    (s + sin(s)) * pow(cos((b1 + b2) / 2) * sin((b2 - b1) / 2) / sin(s / 2), 2))) END AS km
  FROM (SELECT *, 2 * asin(sqrt(least(1.0, pow(sin((b2 - b1) / 2), 2)
      + cos(b1) * cos(b2) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) AS s
    FROM (SELECT *, atan((1 - {f}) * tan(radians({lat1}))) AS b1,
        atan((1 - {f}) * tan(radians({lat2}))) AS b2 FROM {source}) d0) d1)"""


# Pairs of sites within the radius; a supplier has one location.
SITE_SQL = """site AS (SELECT s_suppkey AS sid,
  30 + ((s_suppkey * 37) % 100) * CAST(0.05 AS DOUBLE) AS slat,
  -100 + ((s_suppkey * 61) % 100) * CAST(0.05 AS DOUBLE) AS slon FROM supplier),
spot AS (SELECT DISTINCT slat, slon FROM site)"""
NEAR_SQL = f"""{SITE_SQL},
near_spot AS (SELECT * FROM {lambert_sql("lat1", "lon1", "lat2", "lon2",
    "(SELECT a.slat AS lat1, a.slon AS lon1, b.slat AS lat2, b.slon AS lon2 FROM spot a, spot b) e")}
  g WHERE km <= 100),
near AS (SELECT a.sid AS c_site, b.sid AS p_site FROM near_spot n
  JOIN site a ON a.slat = n.lat1 AND a.slon = n.lon1
  JOIN site b ON b.slat = n.lat2 AND b.slon = n.lon2)"""


def pool_sql(phase: str = "pheno_class_id", unit: str = "id") -> str:
    """Pool rows, and sizes and distribution per current record."""
    key = {
        "pheno_class_id": "id, pheno_class_id",
        "phenophase": "id, phenophase",
        "phenophase_category": "common_name, site_id, phenophase_category",
    }[phase]
    c_key = ", ".join(f"c.{k.strip()}" for k in key.split(","))
    return f"""{NEAR_SQL},
pool AS (SELECT {c_key}, p.first_yes AS pf, p."year" AS py, p.{unit} AS pid,
    p.site_id AS p_site, p.lat AS p_lat, p.lon AS p_lon, p.elev AS p_elev, p.state AS p_state
  FROM cur c JOIN near n ON n.c_site = c.site_id
  JOIN prior p ON p.site_id = n.p_site AND p.common_name = c.common_name
    AND p.{phase} = c.{phase} AND p.elev > c.elev - 1000 AND p.elev < c.elev + 1000),
stat AS (SELECT {key}, count(*) AS n_obs_r, count(DISTINCT py) AS n_yrs_r,
    count(DISTINCT pid) AS n_indiv_r, min(pf) AS "min", quantile_cont(pf, 0.05) AS qearly,
    quantile_cont(pf, 0.25) AS q25, quantile_cont(pf, 0.75) AS q75 FROM pool GROUP BY {key}),
sized AS (SELECT c.*, CASE WHEN k.known IS NOT NULL THEN coalesce(s.n_obs_r, 0) END AS n_obs_r,
    CASE WHEN k.known IS NOT NULL THEN coalesce(s.n_yrs_r, 0) END AS n_yrs_r,
    CASE WHEN k.known IS NOT NULL THEN coalesce(s.n_indiv_r, 0) END AS n_indiv_r,
    s."min", s.qearly, s.q25, s.q75
  FROM cur c LEFT JOIN stat s USING ({key})
  LEFT JOIN (SELECT DISTINCT common_name, {phase}, 1 AS known FROM prior) k
    ON k.common_name = c.common_name AND k.{phase} = c.{phase}),
compared AS (SELECT *, CAST(first_yes < qearly AS INT) AS early,
    CAST(first_yes <= outlier_threshold AS INT) AS outlier,
    CAST(first_yes <= "min" AS INT) AS earliest,
    concat(common_name, '_', {unit}) AS indiv
  FROM (SELECT *, CASE WHEN whisker < "min" THEN "min" ELSE whisker END AS outlier_threshold
    FROM (SELECT *, q25 - 1.5 * iqr AS whisker FROM (SELECT *, q75 - q25 AS iqr FROM sized
      WHERE n_obs_r >= 20 AND n_yrs_r >= 5) t0) t1) t2),
flags AS (SELECT *, concat(indiv, ' (', state, ')') AS panel,
    CASE WHEN outlier = 1 THEN 'Outlier' ELSE 'Early' END AS eo,
    CASE WHEN outlier = 1 THEN 2 ELSE 1 END AS eo_rank
  FROM compared WHERE early = 1 OR outlier = 1)"""


POOL = chain(CLEAN_SQL, OBS_SQL, split_sql(), pool_sql())

VERTEX_SQL = f"""vertex AS (SELECT concat('S', n_nationkey) AS poly_id, n_nationkey, ring_id, seq,
  (n_nationkey % 5 - 100) + dx AS x, (n_nationkey // 5 + 30) + dy AS y
  FROM nation, (VALUES {_VERTEX_VALUES}) v(ring_id, seq, dx, dy)
  WHERE ring_id = 0 OR n_nationkey % 2 = 0)"""
EDGE_SQL = f"""{VERTEX_SQL},
edge AS (SELECT poly_id, ring_id, x AS x1, y AS y1,
  coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
  coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM vertex WINDOW w AS (PARTITION BY poly_id, ring_id ORDER BY seq))"""


def inside_sql(source: str, keys: str, name: str = "located") -> str:
    """Rows of ``source`` (``x, y`` and keys) with the polygon around them."""
    return f"""{name} AS (SELECT {keys}, x, y, poly_id FROM {source} pt JOIN edge e
  ON pt.y >= least(y1, y2) AND pt.y < greatest(y1, y2)
  AND pt.x < x1 + (pt.y - y1) * (x2 - x1) / (y2 - y1)
  GROUP BY {keys}, x, y, poly_id HAVING count(*) % 2 = 1)"""


def cells_sql(name: str, value: str, grid: CellGrid = GRID, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT *, CAST({grid.x0!r} + (col + 0.5) * {grid.res!r} AS DOUBLE) AS lon,
  CAST({grid.y0!r} - ("row" + 0.5) * {grid.res!r} AS DOUBLE) AS lat FROM (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'leaf' ELSE 'bloom' END AS "index",
    CAST(year(l_shipdate) AS INT) AS "year", CAST(l_partkey % {grid.rows} AS INT) AS "row",
    CAST(l_orderkey % {grid.cols} AS INT) AS col, avg({value}) AS "value"
  FROM lineitem GROUP BY ALL) c0 WHERE {where})"""


CELLS_SQL = cells_sql("cells", "dayofyear(l_shipdate)")
COARSE_SQL = cells_sql(
    "coarse", "dayofyear(l_shipdate)", COARSE,
    '"year" = 2001 AND NOT ("row" BETWEEN 8 AND 15 AND col BETWEEN 16 AND 23)',
)
ANOMALY_CELLS_SQL = (
    cells_sql("acells0", "l_quantity", GRID, "\"year\" = 2001 AND \"index\" = 'leaf'")
    + """,
acells AS (SELECT * REPLACE (("value" - 25.5) * 20 AS "value") FROM acells0)"""
)
COUNTY_SQL = """county AS (SELECT concat('S', n_nationkey) AS poly_id,
  lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS STATEFP,
  lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS COUNTYFP,
  concat('S', n_nationkey) AS state, n_name AS county FROM nation)"""
SITE_YEARS_SQL = """long AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS STATEFP,
  lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS COUNTYFP, concat('S', s_nationkey) AS state,
  s_name AS county, "year", CASE WHEN n % 7 = 0 THEN NULL ELSE total / n END AS doy
  FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS "year", count(*) AS n,
    sum(dayofyear(l_shipdate)) AS total FROM lineitem GROUP BY 1, 2) t
  JOIN supplier ON l_suppkey = s_suppkey)"""
NATION_YEARS_SQL = """long AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS STATEFP,
  lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS COUNTYFP, concat('S', s_nationkey) AS state,
  concat('NATION_', s_nationkey) AS county, CAST(year(l_shipdate) AS INT) AS "year",
  sum(dayofyear(l_shipdate)) / count(*) AS doy
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, 5)"""
