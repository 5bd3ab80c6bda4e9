"""Sources, sinks, projections, filters, first records, set operations."""

from pyspark.sql import functions as F

from leafclock import schemas
from leafclock.functions import labels
from leafclock.operators import clean
from leafclock.registry.base import query
from leafclock.registry.standin import (
    ANIMAL_COLUMNS, AUTUMN_COLUMNS, BASE, CLEAN_SQL, OBS_SQL, P, P_ANIMALS, P_AUTUMN,
    PLANT_COLUMNS, PROJECTED_SQL, chain, class_table, cur_prior, first_sql, observations,
    phenophase_table, raw, raw_sql, species_table,
)
from leafclock.sources import observations as src
from leafclock.sources.scratch import scratch_dir
from leafclock.sources.sinks import write_report_table, write_table

CLEANED = chain(CLEAN_SQL)
OBS = chain(CLEAN_SQL, OBS_SQL)
RAW = f"WITH {raw_sql()}\n"
RAW_GAPS = f"WITH {raw_sql(True)}\n"
KEYS = 'site_id, id, pheno_class_id, "year", first_yes'


@query("s1_read_observations", OBS + f"SELECT {PLANT_COLUMNS} FROM obs")
def read_csv(spark, sf_dir):
    path = scratch_dir(spark, "observations")
    columns = schemas.PLANTS.fieldNames()
    write_table(observations(spark, sf_dir).select(*columns), path, fmt="csv")
    return src.read_observations(spark, path)


@query(
    "s3_read_prior_classes",
    OBS + f'SELECT {PLANT_COLUMNS} FROM obs WHERE "year" <= 2000 AND pheno_class_id IN (1, 3, 6)',
)
def read_classes(spark, sf_dir):
    path = scratch_dir(spark, "prior")
    prior = clean.prior_of(observations(spark, sf_dir), P)
    columns = schemas.PLANTS.fieldNames()
    write_table(prior.select(*columns), path, ["pheno_class_id"])
    return src.read_prior(spark, path, (1, 3, 6)).select(*columns)


@query(
    "s4_scan_observations",
    RAW + """SELECT site_id, species_id, pheno_class_id, first_yes_year, first_yes_doy,
  observed_status_conflict_flag FROM raw WHERE first_yes_year IN (1999, 2000)
  AND pheno_class_id IN (1, 7) AND phenophase_id IN (498) AND species_id IN (2, 3, 5)
  AND class_id IN (2, 5)""",
)
def scan(spark, sf_dir):
    rows = src.scan_observations(
        raw(spark, sf_dir), years=(1999, 2000), classes=(1, 7), phenophases=(498,),
        species=(2, 3, 5), taxon_classes=(2, 5),
    )
    return rows.select(
        "site_id", "species_id", "pheno_class_id", "first_yes_year", "first_yes_doy",
        "observed_status_conflict_flag",
    )


@query(
    "s5_in_period",
    RAW + """SELECT site_id, first_yes_year, first_yes_doy, count(*) AS n FROM raw
  WHERE strftime(make_date(first_yes_year, 1, 1) + CAST(first_yes_doy - 1 AS INT), '%m-%d')
    BETWEEN '07-01' AND '12-31' AND first_yes_doy >= 180 GROUP BY ALL""",
)
def period(spark, sf_dir):
    rows = src.from_day(src.in_period(raw(spark, sf_dir), "07-01", "12-31"), 180)
    by = ["site_id", "first_yes_year", "first_yes_doy"]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_dimensions",
    """WITH pp AS (SELECT DISTINCT l_linenumber AS n FROM lineitem)
SELECT 'leaves' AS what, CAST(n + 400 AS BIGINT) AS id FROM pp WHERE n % 2 = 1
UNION ALL SELECT 'animal', CAST(n + 400 AS BIGINT) FROM pp WHERE n + 10 > 13
UNION ALL SELECT 'class', CAST(c AS BIGINT) FROM (SELECT DISTINCT CASE p_type WHEN 'PROMO' THEN 4
  WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS c FROM part) t WHERE c > 3""",
)
def dimensions(spark, sf_dir):
    path = scratch_dir(spark, "dims")
    write_table(phenophase_table(spark, sf_dir), f"{path}/phenophases", fmt="csv")
    columns = schemas.SPECIES.fieldNames()
    write_table(species_table(spark, sf_dir).select(*columns), f"{path}/species", fmt="csv")
    pp = src.read_dimension(spark, f"{path}/phenophases", "phenophases")
    sp = src.read_dimension(spark, f"{path}/species", "species")

    def tagged(df, what, column):
        return df.select(F.lit(what).alias("what"), F.col(column).cast("long").alias("id"))

    leaves = tagged(src.phenophases_of(pp, "Leaves"), "leaves", "phenophase_id")
    animal = tagged(src.animal_phenophases(pp), "animal", "phenophase_id")
    taxa = tagged(src.taxon_classes(sp), "class", "class_id")
    return leaves.unionByName(animal).unionByName(taxa)


@query(
    "s9_write_table",
    OBS + """SELECT pheno_class_id, "year", count(*) AS n, CAST(sum(first_yes) AS BIGINT) AS total
  FROM obs GROUP BY ALL""",
)
def write_partitioned(spark, sf_dir):
    path = scratch_dir(spark, "table")
    write_table(observations(spark, sf_dir), path, ["pheno_class_id", "year"])
    back = spark.read.parquet(path)
    return back.groupBy("pheno_class_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("first_yes").alias("total")
    )


@query(
    "s10_write_report_table",
    OBS + """SELECT 1995 AS first_year, 20011104 AS run_date, pheno_class_id, count(*) AS n
  FROM obs GROUP BY pheno_class_id""",
)
def write_report(spark, sf_dir):
    path = scratch_dir(spark, "report")
    write_report_table(observations(spark, sf_dir), path, "20011104", 1995)
    back = spark.read.csv(path, header=True, schema=(
        "site_id long, lat double, lon double, elev double, state string, common_name string, "
        "species_id long, func_type string, id long, phenophase string, pheno_class_id int, "
        "year int, first_yes int, prior_no int, first_year int, run_date int"
    ))
    return back.groupBy("first_year", "run_date", "pheno_class_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f1_project_raw",
    RAW + """SELECT site_id, latitude AS lat, longitude AS lon, elevation_in_meters AS elev, state,
  common_name, species_id, species_functional_type AS func_type, individual_id AS id,
  phenophase_description AS phenophase, pheno_class_id, first_yes_year AS "year",
  first_yes_doy AS first_yes, numdays_since_prior_no AS prior_no,
  observed_status_conflict_flag AS flag FROM raw""",
)
def project(spark, sf_dir):
    return clean.project_raw(raw(spark, sf_dir))


@query(
    "f2_null_numbers",
    RAW_GAPS + """SELECT site_id, NULLIF(elevation_in_meters, -9999) AS elev,
  NULLIF(numdays_since_prior_no, -9999) AS prior_no FROM raw""",
)
def null_numbers(spark, sf_dir):
    df = clean.project_raw(raw(spark, sf_dir, gaps=True))
    return clean.null_sentinels(df, ["elev", "prior_no"], -9999).select(
        "site_id", "elev", "prior_no"
    )


@query(
    "f3_null_text",
    RAW_GAPS + """SELECT site_id, NULLIF(NULLIF(state, '-9999'), '') AS state,
  NULLIF(NULLIF(observed_status_conflict_flag, '-9999'), '') AS flag FROM raw""",
)
def null_text(spark, sf_dir):
    df = clean.project_raw(raw(spark, sf_dir, gaps=True))
    return clean.null_sentinels(df, ["state", "flag"], ["-9999", ""]).select(
        "site_id", "state", "flag"
    )


PROJ = f"WITH {raw_sql()}, {PROJECTED_SQL}\n"


def _projected(spark, sf_dir, gaps=False):
    return clean.null_markers(clean.project_raw(raw(spark, sf_dir, gaps)))


@query("f4_drop_conflicts", PROJ + f"SELECT {KEYS} FROM proj WHERE flag IS NULL")
def conflicts(spark, sf_dir):
    return clean.drop_conflicts(_projected(spark, sf_dir)).select(
        "site_id", "id", "pheno_class_id", "year", "first_yes"
    )


@query("f5_recent_prior_no", PROJ + f"SELECT {KEYS}, prior_no FROM proj WHERE prior_no <= 30")
def recent(spark, sf_dir):
    return clean.recent_prior_no(_projected(spark, sf_dir), 30).select(
        "site_id", "id", "pheno_class_id", "year", "first_yes", "prior_no"
    )


@query(
    "f6_exclude_species",
    PROJ + f"SELECT {KEYS}, common_name FROM proj WHERE common_name NOT IN ('PROMO')",
)
def exclude(spark, sf_dir):
    return clean.exclude_species(_projected(spark, sf_dir), ["PROMO"]).select(
        "site_id", "id", "pheno_class_id", "year", "first_yes", "common_name"
    )


@query(
    "f7_restrict_states",
    RAW_GAPS + """SELECT site_id, state, count(*) AS n FROM raw
  WHERE state IN ('S1', 'S2', 'S5', 'S11', 'S20', '-9999') GROUP BY ALL""",
)
def states(spark, sf_dir):
    df = clean.project_raw(raw(spark, sf_dir, gaps=True))
    kept = clean.restrict_states(df, ["S1", "S2", "S5", "S11", "S20"], keep_missing=True)
    return kept.groupBy("site_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f8_up_to_day",
    PROJ + f"""SELECT {KEYS} FROM proj WHERE "year" = 2001
  AND first_yes <= dayofyear(DATE '2001-02-02')""",
)
def up_to(spark, sf_dir):
    df = clean.up_to_day(clean.current_of(_projected(spark, sf_dir), P), 2001, "02-02")
    return df.select("site_id", "id", "pheno_class_id", "year", "first_yes")


@query(
    "f9_fold_categories",
    PROJ + """SELECT site_id, pheno_class_id,
  CASE phenophase_category WHEN 'Method' THEN 'Activity' ELSE phenophase_category END
    AS phenophase_category, count(*) AS n
  FROM proj WHERE phenophase_category <> 'Development' GROUP BY ALL""",
)
def categories(spark, sf_dir):
    df = clean.fold_categories(clean.project_raw(raw(spark, sf_dir), "animals"))
    by = ["site_id", "pheno_class_id", "phenophase_category"]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("f10_clean_observations", OBS + f"SELECT {PLANT_COLUMNS} FROM obs")
def cleanup(spark, sf_dir):
    return observations(spark, sf_dir)


@query(
    "f13_sufficient",
    OBS + """SELECT common_name, site_id, count(*) AS n_obs, count(DISTINCT "year") AS n_years
  FROM obs GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT "year") >= 5""",
)
def enough(spark, sf_dir):
    from leafclock.operators.summary import group_sizes

    sizes = group_sizes(observations(spark, sf_dir), ["common_name", "site_id"])
    return clean.sufficient(sizes, 20, 5, "n_obs", "n_years").drop("n_indiv")


@query(
    "f15_class_subset",
    OBS + f"SELECT {KEYS}, func_type FROM obs WHERE pheno_class_id = 7 AND func_type = 'Forb'",
)
def class_subset(spark, sf_dir):
    rows = observations(spark, sf_dir).where("pheno_class_id = 7 AND func_type = 'Forb'")
    return rows.select("site_id", "id", "pheno_class_id", "year", "first_yes", "func_type")


@query(
    "f17_species_state_slice",
    OBS + f"""SELECT {KEYS}, concat(state, '_', common_name) AS state_spp FROM obs
  WHERE concat(state, '_', common_name) = 'S3_LARGE' AND pheno_class_id = 7""",
)
def slice_(spark, sf_dir):
    rows = observations(spark, sf_dir).where(
        "state = 'S3' AND common_name = 'LARGE' AND pheno_class_id = 7"
    )
    return rows.select(
        "site_id", "id", "pheno_class_id", "year", "first_yes",
        labels.joined("state", "common_name").alias("state_spp"),
    )


@query("d1_first_yes_class", OBS + f"SELECT {PLANT_COLUMNS} FROM obs")
def first_class(spark, sf_dir):
    df = clean.recent_prior_no(clean.drop_conflicts(_projected(spark, sf_dir)))
    return clean.first_yes(df, ["id", "pheno_class_id", "year"])


@query(
    "d2_first_yes_phenophase",
    chain(CLEAN_SQL, first_sql(AUTUMN_COLUMNS, 'id, phenophase, "year"'))
    + f"SELECT {AUTUMN_COLUMNS} FROM obs",
)
def first_phenophase(spark, sf_dir):
    return observations(spark, sf_dir, P_AUTUMN, kind="autumn")


FOLDED_SQL = """folded AS (SELECT * REPLACE (CASE phenophase_category WHEN 'Method' THEN 'Activity'
  ELSE phenophase_category END AS phenophase_category) FROM clean
  WHERE phenophase_category <> 'Development')"""
ANIMAL_OBS = first_sql(
    ANIMAL_COLUMNS, 'common_name, site_id, phenophase_category, "year"', "folded"
)


@query(
    "d3_first_yes_category",
    chain(CLEAN_SQL, FOLDED_SQL, ANIMAL_OBS) + f"SELECT {ANIMAL_COLUMNS} FROM obs",
)
def first_category(spark, sf_dir):
    return observations(spark, sf_dir, P_ANIMALS, kind="animals")


@query(
    "d4_first_yes_any_year",
    chain(CLEAN_SQL, first_sql(PLANT_COLUMNS, "pheno_class_id, id"))
    + f"SELECT {PLANT_COLUMNS} FROM obs",
)
def first_any(spark, sf_dir):
    df = clean.recent_prior_no(clean.drop_conflicts(_projected(spark, sf_dir)))
    return clean.first_yes(df, ["pheno_class_id", "id"])


@query("d5_distinct_sites", CLEANED + "SELECT DISTINCT site_id, lon, lat FROM clean")
def sites(spark, sf_dir):
    df = clean.recent_prior_no(clean.drop_conflicts(_projected(spark, sf_dir)))
    return clean.distinct_sites(df)


@query(
    "w1_first_row_rank",
    CLEANED + f"""SELECT id, pheno_class_id, "year", first_yes, rn FROM (
  SELECT id, pheno_class_id, "year", first_yes, CAST(ROW_NUMBER() OVER (
    PARTITION BY id, pheno_class_id, "year" ORDER BY first_yes, site_id, prior_no) AS INT) AS rn
  FROM clean) t WHERE rn <= 2""",
)
def ranked(spark, sf_dir):
    from pyspark.sql import Window

    df = clean.recent_prior_no(clean.drop_conflicts(_projected(spark, sf_dir)))
    w = Window.partitionBy("id", "pheno_class_id", "year").orderBy(
        "first_yes", "site_id", "prior_no"
    )
    return (
        df.select("id", "pheno_class_id", "year", "first_yes", F.row_number().over(w).alias("rn"))
        .where("rn <= 2")
    )


@query(
    "u1_stack_years",
    BASE + f"SELECT {KEYS} FROM prior UNION ALL SELECT {KEYS} FROM cur",
)
def stack(spark, sf_dir):
    cur, prior = cur_prior(spark, sf_dir)
    return prior.unionByName(cur).select("site_id", "id", "pheno_class_id", "year", "first_yes")


@query(
    "u3_key_difference",
    BASE + """SELECT DISTINCT id, pheno_class_id FROM cur
EXCEPT SELECT DISTINCT id, pheno_class_id FROM prior""",
)
def difference(spark, sf_dir):
    from leafclock.operators.pool import missing_keys

    cur, prior = cur_prior(spark, sf_dir)
    return missing_keys(cur, prior, ["id", "pheno_class_id"])


@query(
    "scalar_text",
    """SELECT id, concat(upper(left(name, 1)), lower(substr(name, 2))) AS sentence,
  lower(name) AS lowered, split_part(name, ' ', 2) AS word, replace(name, 'OPEN ', '') AS removed,
  substr(name, 1, 4) AS head FROM (SELECT DISTINCT l_linenumber AS id,
    concat('OPEN flowers ', l_linenumber) AS name FROM lineitem) t
  WHERE NOT contains(name, 'ncep_')""",
)
def scalar_text(spark, sf_dir):
    name = F.col("name")
    return class_table(spark, sf_dir).where(~name.contains("ncep_")).select(
        "id", labels.sentence_case("name").alias("sentence"), F.lower(name).alias("lowered"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("word"),
        F.regexp_replace(name, "OPEN ", "").alias("removed"), F.substring(name, 1, 4).alias("head"),
    )


@query(
    "scalar_dates",
    RAW + """SELECT DISTINCT first_yes_year, first_yes_doy,
  CAST(make_date(first_yes_year, 1, 1) + (first_yes_doy - 1) AS VARCHAR) AS day,
  CAST(dayofyear(make_date(first_yes_year, 2, 2)) AS INT) AS feb2 FROM raw""",
)
def scalar_dates(spark, sf_dir):
    year = F.col("first_yes_year")
    return raw(spark, sf_dir).select(
        "first_yes_year", "first_yes_doy",
        labels.doy_to_date("first_yes_year", "first_yes_doy").alias("day"),
        F.dayofyear(F.make_date(year, F.lit(2), F.lit(2))).alias("feb2"),
    ).distinct()


@query(
    "scalar_rounding",
    """SELECT s_suppkey, round_even(s_acctbal, 0) AS whole, round_even(s_acctbal, 1) AS tenth,
  CAST(floor(s_acctbal / 10) * 10 AS BIGINT) AS tens, CAST(ceil(s_acctbal / 2) AS BIGINT) AS halves
  FROM supplier""",
)
def scalar_rounding(spark, sf_dir):
    v = F.col("s_acctbal")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey", F.bround(v, 0).alias("whole"), F.bround(v, 1).alias("tenth"),
        (F.floor(v / 10) * 10).alias("tens"), F.ceil(v / 2).alias("halves"),
    )
