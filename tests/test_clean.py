import pytest
from pyspark.sql import functions as F

from leafclock import ANIMALS, PLANTS, schemas
from leafclock.functions import labels, stats
from leafclock.operators import clean
from leafclock.sources.observations import in_period, read_observations
from leafclock.sources.sinks import write_table

RAW = (
    "site_id long, latitude double, longitude double, elevation_in_meters double, state string, "
    "common_name string, species_id long, species_functional_type string, individual_id long, "
    "phenophase_description string, phenophase_category string, pheno_class_id int, "
    "first_yes_year int, first_yes_doy int, numdays_since_prior_no int, "
    "observed_status_conflict_flag string"
)


def raw_row(site=1, elev=100.0, state="CA", name="oak", ind=1, cat="Activity", cls=1, year=2024,
            doy=50, prior_no=5, flag="-9999", phase="Leaves"):
    return (site, 40.0, -90.0, elev, state, name, 7, "Forb", ind, phase, cat, cls, year, doy,
            prior_no, flag)


def test_markers_become_null(spark):
    df = spark.createDataFrame(
        [raw_row(elev=-9999.0, state="-9999", prior_no=-9999), raw_row(state="")], RAW
    )
    got = clean.null_markers(clean.project_raw(df)).collect()
    assert got[0].elev is None and got[0].state is None and got[0].prior_no is None
    assert got[0].flag is None and got[1].state is None and got[1].elev == 100.0


def test_cleanup_keeps_first_record(spark, rows):
    df = spark.createDataFrame(
        [
            raw_row(doy=60), raw_row(doy=50, site=2), raw_row(doy=50, site=1),
            raw_row(ind=2, flag="MultiObserver"), raw_row(ind=3, prior_no=31),
            raw_row(ind=4, prior_no=-9999), raw_row(ind=5, name="'ohi'a lehua"),
            raw_row(ind=6, prior_no=30), raw_row(ind=7, name=None),
        ],
        RAW,
    )
    out = clean.clean_observations(df, PLANTS)
    assert rows(out, "id", "first_yes", "site_id") == [(1, 50, 1), (6, 50, 1)]
    assert out.columns == schemas.PLANTS.fieldNames()


def test_first_yes_is_stable_and_idempotent(spark, rows):
    df = clean.null_markers(clean.project_raw(spark.createDataFrame(
        [raw_row(doy=d, prior_no=n, site=s) for d, n, s in
         [(9, 3, 5), (9, 2, 5), (9, 1, 6), (11, 1, 1)]], RAW)))
    keys = ["id", "pheno_class_id", "year"]
    once = clean.first_yes(df, keys)
    assert rows(once, "first_yes", "site_id", "prior_no") == [(9, 5, 2)]
    assert rows(clean.first_yes(once, keys)) == rows(once)
    assert rows(clean.first_yes(df.orderBy(F.desc("prior_no")), keys)) == rows(once)


def test_first_yes_limits_before_the_shuffle(spark):
    df = clean.project_raw(spark.createDataFrame([raw_row()], RAW))
    out = clean.first_yes(df, ["id", "pheno_class_id", "year"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_animal_categories(spark, rows):
    df = spark.createDataFrame(
        [raw_row(cat="Development"), raw_row(cat="Method", doy=40), raw_row(cat="Activity")], RAW
    )
    out = clean.clean_observations(df, ANIMALS, "animals")
    assert rows(out, "phenophase_category", "first_yes") == [("Activity", 40)]


def test_states_and_day_limits(spark, rows):
    df = spark.createDataFrame([("CA", 33), ("AK", 33), ("-9999", 34), (None, 1)],
                               "state string, first_yes int")
    assert rows(clean.restrict_states(df, ["CA"]), "state") == [("CA",)]
    assert rows(clean.restrict_states(df, ["CA"], True), "state") == [("-9999",), ("CA",)]
    assert rows(clean.up_to_day(df, 2025), "first_yes") == [(1,), (33,), (33,)]


def test_period_uses_each_rows_year(spark, rows):
    df = spark.createDataFrame([(2024, 182), (2024, 183), (2023, 181), (2023, 182)],
                               "first_yes_year int, first_yes_doy int")
    # July 1 is day 183 in a leap year and 182 otherwise.
    assert rows(in_period(df, "07-01", "12-31")) == [(2023, 182), (2024, 183)]


def test_labels(spark):
    df = spark.createDataFrame([(None, "oak", 3, "OPEN Flowers", "Forb", 2024, 60)],
                               "state string, common_name string, id long, t string, "
                               "func_type string, year int, first_yes int")
    got = df.select(
        labels.joined("state", "common_name").alias("a"), labels.sentence_case("t").alias("b"),
        labels.func_type_code().alias("c"), labels.doy_to_date("year", "first_yes").alias("d"),
        labels.panel(labels.indiv()).alias("e"),
    ).first()
    assert got.a == "NA_oak" and got.b == "Open flowers" and got.c == "Forb"
    assert str(got.d) == "2024-02-29" and got.e == "oak_3 (NA)"


@pytest.mark.parametrize("values", [[3, 7, 8, 12, 20, 41], [5], [1, 1, 1, 9], list(range(1, 42))])
def test_counted_quantiles_match_numpy(spark, values):
    import numpy as np

    df = spark.createDataFrame([("g", v) for v in values], "k string, v int")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probs = {"a": 0.05, "b": 0.25, "c": 0.75}
    got = stats.count_quantiles(counts, ["k"], "v", "n", probs).first()
    plain = df.agg(stats.quantiles("v", probs.values())).first()[0]
    for name, q, spark_q in zip(probs, probs.values(), plain):
        want = np.quantile(values, q)
        assert got[name] == pytest.approx(want) and spark_q == pytest.approx(want)


def test_year_bits_hold_any_span(spark):
    years = range(1900, 2050)
    df = spark.createDataFrame([(y,) for y in (1900, 1962, 1963, 2049, 2049)], "year int")
    bits = df.select(*stats.year_bits(F.col("year"), years)).agg(*stats.or_years(years))
    assert bits.select(stats.count_years(years)).first()[0] == 4


def test_distinct_counts_missing(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, 5)], "k int, i int")
    got = {r.k: r.n for r in df.groupBy("k").agg(stats.n_distinct("i").alias("n")).collect()}
    assert got == {1: 2, 2: 1}


def test_csv_round_trip(spark, rows, tmp_path):
    df = clean.clean_observations(spark.createDataFrame([raw_row(elev=-9999.0)], RAW), PLANTS)
    path = write_table(df, str(tmp_path / "obs"), fmt="csv")
    assert rows(read_observations(spark, path)) == rows(df)
    text = next((tmp_path / "obs").glob("part-*")).read_text()
    assert ",NA," in text


def test_reference_shaped_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '"site_id","lat","lon","elev","state","common_name","species_id","func_type","id",'
        '"phenophase","pheno_class_id","year","first_yes","prior_no"\n'
        '901,41.25,-80.5,NA,"ZZ","made-up shrub",7001,"Forb",55001,"Buds",2,2031,77,9\n'
    )
    got = read_observations(spark, str(tmp_path / "a.csv")).first()
    assert got.elev is None and got.common_name == "made-up shrub" and got.first_yes == 77


@pytest.mark.parametrize("start, end", [
    ("07-01", "12-31"), ("02-20", "03-05"), ("02-29", "02-29"), ("02-29", "06-30"), ("01-01", "02-29"), ("11-15", "03-01"),
    ("12-31", "01-01"), ("03-01", "02-28"), ("01-01", "12-31")])
def test_period_of_leap_and_common_years(spark, rows, start, end):
    from datetime import date, timedelta

    days = [(y, d) for y in (1900, 2000, 2023, 2024) for d in range(0, 368)] + [(None, 5), (2024, None)]
    df = spark.createDataFrame(days, "first_yes_year int, first_yes_doy int")

    def inside(y, d):
        at = date(y, 1, 1) + timedelta(days=d - 1)
        mmdd = at.strftime("%m-%d")
        return at.year == y and (start <= mmdd <= end if start <= end else mmdd >= start or mmdd <= end)

    want = sorted((y, d) for y, d in days if y and d is not None and inside(y, d))
    assert rows(in_period(df, start, end)) == want
    assert rows(in_period(df, start, end, years=[2000, 2023, 1999])) == [x for x in want if x[0] in (2000, 2023)]


def test_period_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "obs")
    spark.createDataFrame([(2024, 180, 1)], "first_yes_year int, first_yes_doy int, v int").write.parquet(path)
    df = spark.read.parquet(path)

    def pushed(out):
        spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
        plan = out._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        return plan.split("PushedFilters: [")[1].split("ReadSchema")[0]

    plain = pushed(in_period(df, "07-01", "12-31"))
    assert "GreaterThanOrEqual(first_yes_doy,182)" in plain and "LessThanOrEqual(first_yes_doy,366)" in plain
    assert "Or(" in pushed(in_period(df, "11-15", "03-01"))
    by_year = pushed(in_period(df, "07-01", "12-31", years=[2023, 2024]))
    assert "first_yes_year" in by_year and "GreaterThanOrEqual(first_yes_doy,183)" in by_year
