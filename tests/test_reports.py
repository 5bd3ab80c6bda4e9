from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leafclock import PLANTS, schemas
from leafclock.operators import county, refresh, state, summary
from leafclock.sources.grids import polygon_edges
from leafclock.sources.scratch import scratch_dir
from tests.test_places import V, square

LONG = "STATEFP string, COUNTYFP string, state string, county string, year int, doy double"
KEY = ("01", "003", "AL", "Baldwin")


def long_of(spark, values):
    return spark.createDataFrame([(*KEY, y, v) for y, v in values.items()], LONG)


def test_wide_and_long_forms(spark, rows, tmp_path):
    from leafclock.sources.grids import read_county_index
    from leafclock.sources.sinks import write_table

    df = long_of(spark, {2000: 5.0, 2001: None, 2002: 7.5})
    wide = county.to_wide(df, [2000, 2001, 2002])
    assert wide.columns == [*county.COUNTY, "doy_2000", "doy_2001", "doy_2002"]
    assert rows(county.to_long(wide)) == rows(df)
    path = write_table(wide, str(tmp_path / "c"), fmt="csv")
    back = read_county_index(spark, path, [2000, 2001, 2002])
    assert rows(back) == rows(wide) and back.first().COUNTYFP == "003"
    assert county.last_years_wide(wide, 2002, 1).columns[-2:] == ["doy_2001", "doy_2002"]
    named = county.with_fips(df)
    name = "AL_Baldwin_01003"
    assert rows(county.to_wide_by_year(named, [name]), "year", name) == [
        (2000, 5.0), (2001, None), (2002, 7.5)]


def test_ranks_count_missing_years(spark):
    df = long_of(spark, {2020: 10.0, 2021: None, 2022: 30.0, 2023: 20.0, 2024: 20.0})
    got = county.rank_against_history(df, 2024, 4).first()
    # A missing year counts on both sides, and voids mean and median.
    assert (got.n_earlier, got.n_later, got.mean40, got.median40) == (2, 2, None, None)
    sane = county.rank_against_history(df, 2024, 4, na_counts=False).first()
    assert (sane.n_earlier, sane.n_later) == (1, 1)
    # A year without a row is missing too.
    absent = county.rank_against_history(df.where("doy IS NOT NULL"), 2024, 4).first()
    assert tuple(absent) == tuple(got)
    assert county.rank_against_history(df, 2024, 40).first().n_earlier == 38
    full = county.rank_against_history(df.where("doy IS NOT NULL"), 2024, 2).first()
    assert (full.mean40, full.median40) == (25.0, 25.0)
    none = county.rank_against_history(df.where("year < 2024"), 2024, 4).first()
    assert (none.currentyr, none.n_earlier, none.n_later) == (None, 4, 4)


def test_return_intervals(spark):
    df = spark.createDataFrame([(0,), (1,), (20,)], "n int")
    got = df.select(county.return_interval("n").alias("a"),
                    county.return_interval("n", inclusive=True).alias("b")).collect()
    assert [r.a for r in got] == [None, 41.0, 41 / 20]
    assert [r.b for r in got] == [41.0, 20.5, 41 / 21]


def test_baseline_anomaly_limits(spark):
    years = {y: 10.0 + y % 2 * 10 for y in range(1991, 2021)} | {2025: 3.0}
    anom = county.anomaly(long_of(spark, years), 2025)
    assert tuple(anom.first())[-3:] == (3.0, 15.0, -12.0)
    assert tuple(county.anomaly_limits(anom).first()) == (12.0, 10)
    for gap in (years | {2000: None}, {y: d for y, d in years.items() if y != 2000}):
        assert county.baseline(long_of(spark, gap)).first().baseline is None
    late = county.anomaly(long_of(spark, {y: d for y, d in years.items() if y < 2025}), 2025)
    assert tuple(late.first())[-3:] == (None, 15.0, None)


def test_histogram_bins(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("b", 10), ("b", 9), ("b", None)],
                               "panel string, v int")
    got = rows(summary.histogram(df, "v", 10, ["panel"]), "panel", "bin", "n")
    assert got == [("a", 0, 1), ("a", 5, 1), ("b", 9, 2)]
    one = spark.createDataFrame([("a", 4), ("a", 4)], "panel string, v int")
    assert rows(summary.histogram(one, "v", 10, ["panel"]), "bin", "n") == [(0, 2)]


def test_summaries_round_half_to_even(spark):
    df = spark.createDataFrame(
        [("oak", "CA", "Yes", "No", "No", 2, 3), ("oak", "NV", "Yes", "Yes", "Yes", 3, 4)],
        "common_name string, state string, early string, earliest string, outlier string, "
        "n_yrs_r long, n_obs_r long",
    )
    got = summary.summary_by(df, ["common_name"]).first()
    assert tuple(got) == ("oak", 2, 1, 1, 2, 4)
    assert summary.summary_by(df, ["state"], True).where("state = 'CA'").first().n_species == 1


def test_group_sizes_count_every_year(spark):
    df = spark.createDataFrame(
        [("a", 1, 2008), ("a", None, 2010), ("a", None, None), ("a", 1, 1900), (None, 2, None)],
        "k string, id long, year int")
    got = {r.k: (r.n_obs, r.n_indiv, r.n_years) for r in summary.group_sizes(df, ["k"]).collect()}
    assert got == {"a": (4, 2, 4), None: (1, 1, 1)}


def test_site_coverage(spark):
    sizes = spark.createDataFrame(
        [(1, 10, 12, 10), (1, 10, 3, 2), (1, 11, 10, 5), (1, 12, 9, 5)],
        "pheno_class_id int, site_id long, n_obs long, n_years long",
    )
    got = summary.site_coverage(sizes).first()
    assert (got.n_sites, got.n_sites_10, got.n_sites_5_10) == (3, 1, 2)


OBS = "site_id long, lat double, lon double, elev double, state string, common_name string, " \
      "func_type string, id long, pheno_class_id int, year int, first_yes int"


def test_state_comparison_is_strict(spark, rows):
    p = PLANTS.with_(min_obs=4, min_yrs=2)

    def row(i, st, year, d):
        return (i, 40.0, -90.0, 1.0, st, "oak", "Forb", i, 1, year, d)

    prior = spark.createDataFrame(
        [row(i, "CA", 2010 + i, d) for i, d in enumerate([50, 52, 54, 56, 58])]
        + [row(9, "NV", 2012, 10)], OBS)
    cur = spark.createDataFrame(
        [row(1, "CA", 2025, 50), row(2, "CA", 2025, 49), row(3, "NV", 2025, 1)], OBS)
    got = state.flagged_in_state(state.compare_in_state(cur, prior, p))
    assert rows(got, "id", "early", "outlier", "panel") == [
        (1, 1, 0, "oak (CA)"), (2, 1, 1, "oak (CA)")]
    panels = state.state_panels(prior, got, p)
    assert rows(panels.groupBy("group").count()) == [("All", 6), ("State", 5)]


RAW = (
    "site_id long, latitude double, longitude double, elevation_in_meters double, state string, "
    "common_name string, species_id long, species_functional_type string, individual_id long, "
    "phenophase_description string, pheno_class_id int, first_yes_year int, first_yes_doy int, "
    "numdays_since_prior_no int, observed_status_conflict_flag string"
)


@pytest.fixture
def world(spark):
    raw = []
    for sp in range(1, 5):
        for cls in (1, 3):
            for year in range(2009, 2026):
                for ind in (1, 2):
                    raw.append((ind, 0.5, 0.5 + ind % 2, -9999.0 if ind == 1 else 5.0,
                                "-9999" if ind == 2 else "CA", f"sp{sp}", sp, "Forb",
                                sp * 10 + ind, "Leaves", cls, year, 50 + sp, 3, "-9999"))
    edges = polygon_edges(spark.createDataFrame(square("CA", 0, 0) + square("NV", 1, 0), V))
    elev = spark.createDataFrame([(1, 9.6)], "site_id long, elevation double")
    return spark.createDataFrame(raw, RAW), edges, elev


def test_prepare_keeps_to_the_scope(spark, world):
    from leafclock.params import ANIMALS, AUTUMN
    from leafclock.plans import anomalies

    raw, edges, elev = world
    classes = lambda p, **c: {
        r[0] for r in anomalies.prepare(raw, edges, elev, p.with_(**c)).select("pheno_class_id").distinct().collect()}
    assert classes(PLANTS) == {1, 3}
    assert classes(PLANTS, pheno_class_ids=(3,)) == {3}
    assert classes(PLANTS, pheno_class_ids=()) == {1, 3}
    assert classes(PLANTS, period=("02-01", "02-19")) == set()
    assert classes(PLANTS, period=("02-20", "02-28")) == {1, 3}
    years = anomalies.prepare(raw, edges, elev, PLANTS.with_(year=2012)).select("year").distinct()
    assert sorted(r[0] for r in years.collect()) == [2009, 2010, 2011, 2012]
    late = raw.drop("pheno_class_id").selectExpr("*", "IF(first_yes_doy > 52, 498, 7) AS phenophase_id").withColumns(
        {"first_yes_doy": F.col("first_yes_doy") + F.when(F.col("species_id") == 4, 200).otherwise(0)})
    out = anomalies.prepare(late, edges, elev, AUTUMN, "autumn")
    assert {(r.phenophase_id, r.first_yes >= 180) for r in out.collect()} == {(498, True)}
    p = ANIMALS.with_(min_obs=1, min_yrs=1)
    beasts = raw.drop("individual_id").withColumn("phenophase_category", F.lit("Activity")).withColumn(
        "first_yes_doy", F.expr("IF(first_yes_year = 2025, 20, first_yes_doy)"))
    cur, prior = anomalies.split(anomalies.prepare(beasts, edges, elev, p, "animals"), p)
    report = anomalies.radius_report(cur, prior, p)
    assert report.count() > 0 and "site_id" in report.columns and "id" not in report.columns


def test_refresh_in_steps_equals_from_scratch(spark, rows, world):
    from leafclock.operators.clean import clean_observations, current_of

    raw, edges, elev = world
    p = PLANTS.with_(pheno_class_ids=(1, 3))
    cur = current_of(clean_observations(raw, p), p).where("NOT (species_id = 4 AND pheno_class_id = 3)")
    whole = scratch_dir(spark, "t")
    at_once = refresh.refresh_prior(spark, raw, whole, cur, edges, elev, p, "a")
    steps = scratch_dir(spark, "t")
    some = cur.where("species_id <= 2 AND pheno_class_id = 1")
    refresh.refresh_prior(spark, raw, steps, some, edges, elev, p.with_(year=2015), "a")
    in_steps = refresh.refresh_prior(spark, raw, steps, cur, edges, elev, p, "b")
    assert rows(in_steps) == rows(at_once)
    # 7 species-class pairs, 16 years, 2 individuals.
    assert at_once.count() == 7 * 16 * 2
    assert rows(at_once.where("site_id = 1").select("elev").distinct()) == [(10.0,)]
    again = refresh.refresh_prior(spark, raw, steps, cur, edges, elev, p, "c")
    assert again.count() == at_once.count()


def test_unfinished_batch_is_ignored(spark, rows, world, tmp_path):
    import os

    from leafclock.operators.clean import clean_observations, current_of

    raw, edges, elev = world
    p = PLANTS.with_(pheno_class_ids=(1, 3))
    cur = current_of(clean_observations(raw, p), p)
    path = str(tmp_path / "cache")
    full = rows(refresh.refresh_prior(spark, raw, path, cur, edges, elev, p, "a"))
    os.remove(f"{path}/batch=a/_SUCCESS")
    assert refresh.read_cache(spark, path).count() == 0
    assert rows(refresh.refresh_prior(spark, raw, path, cur, edges, elev, p, "a")) == full


def test_prior_reader_prunes_classes(spark, tmp_path):
    from leafclock.sources.observations import read_prior
    from leafclock.sources.sinks import write_table

    row = (1, 40.0, -90.0, 1.0, "CA", "oak", 7, "Forb", 1, "Leaves")
    df = spark.createDataFrame([(*row, c, 2020, 5, 1) for c in (1, 3, 6)], schemas.PLANTS)
    path = write_table(df, str(tmp_path / "p"), ["pheno_class_id"])
    out = read_prior(spark, path, (1, 6))
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [pheno_class_id" in plan


def test_working_folder_follows_the_cluster_setting(spark):
    def session(master, setting):
        conf = SimpleNamespace(get=lambda key, default: setting)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert scratch_dir(session("yarn", "s3://b/x"), "y").startswith("s3://b/x/leafclock-y-")
    with pytest.raises(ValueError):
        scratch_dir(session("yarn", None))
    assert "leafclock" in scratch_dir(spark)


def test_group_sizes_plan_has_no_expand(spark):
    df = spark.createDataFrame([("a", 1, 2010)], "k string, id long, year int")
    plan = summary.group_sizes(df, ["k"])._jdf.queryExecution().executedPlan()
    assert "Expand" not in plan.toString()


def test_individuals_are_not_broadcast_to_join_the_records(spark, tmp_path):
    from leafclock.registry.standin import raw

    spark.createDataFrame(
        [(1, 7, 1, 1, 5.0, "N", "O", "2001-03-01"), (1, 7, 2, 2, 6.0, "N", "O", "2001-03-02"), (2, 8, 1, 1, 7.0, "R", "F", "2001-04-01"),
         (3, None, 1, 1, 7.0, "R", "F", "2001-04-01")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
        "l_linestatus string, l_shipdate string",
    ).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "SMALL"), (8, "LARGE"), (8, "LARGE")], "p_partkey long, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 3, 10.0), (2, 4, 20.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet")
    df = raw(spark, str(tmp_path))
    got = sorted((r.individual_id, r.site_id, r.common_name, r.state) for r in df.collect())
    assert got == [(7, 1, "SMALL", "S3"), (7, 2, "SMALL", "S4"), (8, 1, "LARGE", "S3"), (8, 1, "LARGE", "S3")]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan
