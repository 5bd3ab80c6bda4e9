import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafclock import PLANTS
from leafclock.functions.geodesy import RadiusGrid, distance_km
from leafclock.operators import anomaly, pool
from leafclock.sources.scratch import staged

COLUMNS = (
    "site_id long, lat double, lon double, elev double, state string, common_name string, "
    "func_type string, id long, pheno_class_id int, year int, first_yes int"
)


def km(lat1, lon1, lat2, lon2):
    """Lambert distance in plain Python."""
    f, a = 1 / 298.257223563, 6378.137
    b1, b2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    dl = math.radians(lon2 - lon1)
    h = math.sin((b2 - b1) / 2) ** 2 + math.cos(b1) * math.cos(b2) * math.sin(dl / 2) ** 2
    if h == 0:
        return 0.0
    s = 2 * math.asin(min(1.0, math.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - math.sin(s)) * (math.sin(p) * math.cos(q) / math.cos(s / 2)) ** 2
    y = (s + math.sin(s)) * (math.cos(p) * math.sin(q) / math.sin(s / 2)) ** 2
    return a * (s - f / 2 * (x + y))


def brute_pool(c, prior, p):
    """Prior rows of one current row, one by one."""
    same = [r for r in prior if r[5] == c[5] and r[8] == c[8] and c[5] is not None]
    near = {
        r[0] for r in same
        if None not in (c[1], c[2], r[1], r[2]) and km(c[1], c[2], r[1], r[2]) <= p.radius_km
    }
    return same, [
        r for r in same
        if r[0] in near and None not in (c[3], r[3]) and abs(r[3] - c[3]) < p.elev_buffer
    ]


def make(seed, n, lat0, lon0, spread, moved=0.0, elev=2500, dense=False):
    """Random rows: sites around a point, several records each, some gaps."""
    rnd = random.Random(seed)

    def wrap(lon):
        return (lon + 180) % 360 - 180

    sites = {}
    for s in range(max(3, n // 12)):
        lat = max(-89.9, min(89.9, lat0 + rnd.uniform(-spread, spread)))
        e = None if rnd.random() < 0.05 else float(rnd.randint(0, elev))
        sites[s] = (lat, wrap(lon0 + rnd.uniform(-spread, spread)), e)
    out = []
    for _ in range(n):
        s = 0 if dense and rnd.random() < 0.4 else rnd.randrange(len(sites))
        lat, lon, e = sites[s]
        if rnd.random() < moved:
            lat, lon = lat + rnd.uniform(-0.8, 0.8), wrap(lon + rnd.uniform(-0.8, 0.8))
        ident = None if rnd.random() < 0.05 else rnd.randrange(n // 3 + 1)
        out.append((s, lat, lon, e, f"S{s % 3}", rnd.choice(["oak", "elm"]), "Forb", ident,
                    rnd.choice([1, 7]), rnd.randint(2009, 2024), rnd.randint(1, 120)))
    return out


CASES = {
    "mid_latitude": dict(lat0=40.0, lon0=-90.0, spread=1.5),
    "moved_sites": dict(lat0=45.0, lon0=-100.0, spread=1.2, moved=0.3),
    "hot_site": dict(lat0=35.0, lon0=-95.0, spread=0.6, dense=True),
    "date_line": dict(lat0=52.0, lon0=180.0, spread=1.5),
    "far_north": dict(lat0=88.9, lon0=10.0, spread=1.0),
    "equator": dict(lat0=0.0, lon0=0.0, spread=1.2),
}


@pytest.mark.parametrize("name", CASES)
def test_pool_equals_brute_force(spark, name):
    p = PLANTS.with_(min_obs=1, min_yrs=1)
    prior = make(1, 500, **CASES[name])
    if name == "far_north":
        prior = [(*r[:2], random.Random(r[0]).uniform(-180, 180), *r[3:]) for r in prior]
    cur = [r[:9] + (2025, r[10]) for r in make(2, 60, **CASES[name])]
    cur.append((99, 40.0, -90.0, 10.0, "S1", "fern", "Forb", 1, 1, 2025, 5))
    cur.append((99, 40.0, -90.0, 10.0, "S1", None, "Forb", 1, 1, 2025, 5))
    cur = [(*r[:7], i, *r[8:]) for i, r in enumerate(cur)]
    got = pool.pool_sizes(
        spark.createDataFrame(cur, COLUMNS), spark.createDataFrame(prior, COLUMNS), p
    )
    got = {r.id: r for r in got.collect()}
    assert len(got) == len(cur)
    filled = 0
    for c in cur:
        same, want = brute_pool(c, prior, p)
        r = got[c[7]]
        if not same:
            assert (r.n_obs_r, r.n_yrs_r, r.n_indiv_r) == (None, None, None)
            continue
        assert r.n_obs_r == len(want)
        assert r.n_yrs_r == len({w[9] for w in want})
        assert r.n_indiv_r == len({w[7] for w in want})
        if want:
            filled += 1
            days = [w[10] for w in want]
            assert r.min == min(days)
            for column, q in (("qearly", 0.05), ("q25", 0.25), ("q75", 0.75)):
                assert r[column] == pytest.approx(np.quantile(days, q))
    assert filled > 5


def test_pool_rows_equal_brute_force(spark):
    p = PLANTS
    prior = make(3, 400, **CASES["moved_sites"])
    cur = [(*r[:7], i, r[8], 2025, r[10])
           for i, r in enumerate(make(4, 30, **CASES["moved_sites"]))]
    got = pool.neighbour_pool(
        spark.createDataFrame(cur, COLUMNS).withColumn("cid", F.col("id")),
        spark.createDataFrame(prior, COLUMNS), p, carry=("cid",),
    )
    got = sorted((r.cur_cid, r.site_id, r.year, r.first_yes, r.lat, r.elev) for r in got.collect())
    want = sorted(
        (c[7], w[0], w[9], w[10], w[1], w[3]) for c in cur for w in brute_pool(c, prior, p)[1]
    )
    assert got == want and got


def test_no_cross_or_nested_loop_join(spark):
    p = PLANTS
    prior = spark.createDataFrame(make(1, 50, **CASES["equator"]), COLUMNS)
    cur = spark.createDataFrame(make(2, 20, **CASES["equator"]), COLUMNS)
    for df in (pool.pool_sizes(cur, prior, p), pool.neighbour_pool(cur, prior, p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_elevation_band_is_open(spark):
    base = (1, 40.0, -90.0, 1000.0, "S1", "oak", "Forb", 1, 1, 2025, 10)
    prior = [(*base[:3], e, *base[4:9], 2020, 10) for e in (0.0, 0.5, 1999.5, 2000.0, None)]
    got = pool.pool_sizes(
        spark.createDataFrame([base], COLUMNS), spark.createDataFrame(prior, COLUMNS), PLANTS
    ).first()
    assert got.n_obs_r == 2


def test_tile_bounds_hold(spark):
    """Every pair of points lies between the bounds of its tiles."""
    rnd = random.Random(5)
    g = RadiusGrid(100.0, 8)
    pts = []
    for _ in range(4000):
        lat, lon = rnd.uniform(-89, 89), rnd.uniform(-180, 180)
        pts.append((lat, lon, max(-90.0, min(90.0, lat + rnd.uniform(-2, 2))),
                    (lon + rnd.uniform(-3, 3) + 180) % 360 - 180))
    df = spark.createDataFrame(pts, "lat double, lon double, lat2 double, lon2 double")
    r1, c1 = g.tile_row(F.col("lat")), g.tile_col(F.col("lon"))
    r2, c2 = g.tile_row(F.col("lat2")), g.tile_col(F.col("lon2"))
    low1, high1 = g.tile_cosines(r1)
    low2, high2 = g.tile_cosines(r2)
    across = F.abs(c1 - c2)
    cols = F.least(across, F.lit(g.tile_cols) - across)
    rows = F.abs(r1 - r2)
    d = distance_km(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")])
    near = g.nearest(rows, cols, low1 * low2) <= g.hav_maybe
    sure = g.farthest(rows, cols, high1 * high2) <= g.hav_surely
    got = df.select(d.alias("d"), near.alias("near"), sure.alias("sure")).collect()
    assert all(r.near for r in got if r.d <= 100) and all(r.d <= 100 for r in got if r.sure)
    assert sum(r.sure for r in got) > 50 and sum(not r.near for r in got) > 500


def test_distance(spark):
    df = spark.createDataFrame([(50.0, -5.0, 58.0, -3.0), (40.0, -90.0, 40.0, -90.0),
                                (10.0, 179.9, 10.0, -179.9)],
                               "a double, b double, c double, d double")
    args = [F.col(c) for c in "abcd"]
    got = df.select(distance_km(*args).alias("e"), distance_km(*args, "sphere").alias("s")).collect()
    for r, row in zip(got, df.collect()):
        assert r.e == pytest.approx(km(*row), abs=1e-6)
        assert r.s == pytest.approx(r.e, rel=0.006)
    assert got[1].e == 0.0 and got[2].e < 25


def test_flags_and_thresholds(spark):
    p = PLANTS.with_(min_obs=5, min_yrs=3)
    place = (1, 40.0, -90.0, 100.0, "S1", "oak", "Forb")
    prior = [(*place, i, 1, 2010 + i % 6, d)
             for i, d in enumerate([50, 52, 54, 55, 56, 57, 58, 60, 61, 63])]
    cur = [(*place, 1, 1, 2025, 50), (*place, 2, 1, 2025, 51), (*place, 3, 1, 2025, 40)]
    flags = anomaly.flagged_rows(anomaly.compare_with_pool(
        spark.createDataFrame(cur, COLUMNS), spark.createDataFrame(prior, COLUMNS), p))
    got = {r.id: r for r in flags.collect()}
    # q05 = 50.9, q25 = 54.25, q75 = 59.5, whisker = 46.375 < min 50 -> threshold 50.
    assert set(got) == {1, 3}
    assert got[1].outlier == 1 and got[1].early == 1 and got[1].earliest == 1
    assert got[1].outlier_threshold == 50.0 and got[1].eo == "Outlier"
    strict = anomaly.flag(flags.drop("early", "outlier", "earliest"), inclusive=False)
    assert {r.id: r.outlier for r in strict.collect()} == {1: 0, 3: 1}
    for r in got.values():
        assert not r.early or r.first_yes < r.qearly


@pytest.mark.parametrize("case", sorted(CASES))
def test_stored_pools_expand_to_the_same_rows(spark, case):
    p = PLANTS
    prior_rows = make(3, 300, **CASES[case])
    cur = [(*r[:7], i, r[8], 2025, r[10]) for i, r in enumerate(make(4, 25, **CASES[case]))]
    prior = spark.createDataFrame(prior_rows, COLUMNS)
    now = spark.createDataFrame(cur, COLUMNS)
    index = pool.pool_index(now, prior, p)
    key = [*p.group_keys, *pool.PLACE]
    named = now.select(*key, F.col("id").alias("cid")).join(index.keys.select("pool", *key), key).select("pool", "cid")

    def listed(df):
        return sorted((r.cid, r.site_id, r.year, r.first_yes, r.lat, r.elev) for r in df.collect())

    want = sorted((c[7], w[0], w[9], w[10], w[1], w[3]) for c in cur for w in brute_pool(c, prior_rows, p)[1])
    assert listed(named.join(pool.pool_rows(index, prior, p), "pool")) == want
    some = now.where("id IN (1, 4)")
    places = {(c[1], c[2], c[3]) for c in cur if c[7] in (1, 4)}
    own = {c[7] for c in cur if (c[1], c[2], c[3]) in places}
    got = listed(named.join(pool.pool_rows(index, prior, p, of=some), "pool"))
    assert [r for r in got if r[0] in (1, 4)] == [r for r in want if r[0] in (1, 4)] and {r[0] for r in got} <= own


def test_stored_pools_do_not_grow_with_the_records(spark):
    p = PLANTS
    rows = make(5, 200, **CASES["equator"])
    cur = spark.createDataFrame([(*r[:7], i, r[8], 2025, r[10]) for i, r in enumerate(make(6, 15, **CASES["equator"]))], COLUMNS)
    few = spark.createDataFrame(rows, COLUMNS)
    many = few.join(spark.range(50).withColumnRenamed("id", "k")).withColumn("first_yes", F.col("first_yes") + F.col("k") % 7).drop("k")
    sizes = [(i.cells.count(), i.places.count()) for i in (pool.pool_index(cur, df, p) for df in (few, many))]
    assert sizes[0] == sizes[1]


def test_panel_rows_are_moved_by_place_not_by_pair(spark):
    """Current and prior rows meet where pairs are written: none is moved behind the last join."""
    p = PLANTS
    rows = spark.createDataFrame(make(7, 200, **CASES["equator"]), COLUMNS)
    now = spark.createDataFrame(
        [(*r[:7], i, r[8], 2025, r[10]) for i, r in enumerate(make(8, 15, **CASES["equator"]))], COLUMNS)
    flags = now.withColumns({"indiv": F.concat("common_name", F.lit("_"), "id"), "panel": F.col("state")})
    index = pool.pool_index(flags, rows, p)
    for df in (anomaly.panel_pool(flags, rows, p), anomaly.read_panels(index, flags, rows, p)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        pairs = [line for line in plan if "Join" in line and "u_elev" in line]
        assert pairs and all("block" in line for line in pairs)
        depth = [len(line) - len(line.lstrip(" :+-")) for line in plan if "Join" in line]
        first = next(line for line in plan if "Join" in line)
        assert "u_elev" in first and min(depth) == depth[0]


def test_shown_values_are_made_before_rows_are_copied_to_panels(spark, rows):
    """What replaces columns of prior rows takes no part in the pools, and stands below the join that forms pairs."""
    p = PLANTS
    prior_rows = make(9, 300, **CASES["moved_sites"])
    cur = [(*r[:7], i, r[8], 2025, r[10]) for i, r in enumerate(make(10, 25, **CASES["moved_sites"]))]
    prior = spark.createDataFrame(prior_rows, COLUMNS)
    flags = spark.createDataFrame(cur, COLUMNS).withColumns({"indiv": F.col("id").cast("string"), "panel": F.col("state")})
    shown = {"lat": F.round(F.col("lat"), 1), "elev": -F.col("elev")}
    want = Counter((str(c[7]), w[0], float(-w[3]), w[9], w[10]) for c in cur for w in brute_pool(c, prior_rows, p)[1])
    plain = anomaly.panel_pool(flags, prior, p)
    index = pool.pool_index(flags, prior, p)
    for df in (anomaly.panel_pool(flags, prior, p, shown), anomaly.read_panels(index, flags, prior, p, shown=shown)):
        assert df.columns == plain.columns
        assert Counter(map(tuple, df.select("indiv", "site_id", "elev", "year", "first_yes").collect())) == want and want
        assert rows(df, *df.columns) == rows(plain.withColumns(shown), *df.columns)
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
        assert "round(" not in plan[0] and "round(" in plan[1]


def test_panel_queries_round_prior_rows_not_pairs(spark, tmp_path):
    from leafclock.registry import QUERIES

    items = [(part, 0, 1, f"{year}-05-{10 + part:02d}", 10.0, "N", "O") for part in range(6) for year in range(1995, 2001)]
    items.append((0, 0, 1, "2001-03-01", 10.0, "N", "O"))
    tables = {
        "lineitem": (items, "l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string, l_quantity double, "
                            "l_returnflag string, l_linestatus string"),
        "part": ([(i, "SMALL") for i in range(6)], "p_partkey long, p_type string"),
        "supplier": ([(0, 3, 1234.5)], "s_suppkey long, s_nationkey int, s_acctbal double"),
    }
    for name, (some, schema) in tables.items():
        df = spark.createDataFrame(some, schema)
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("j14_panel_pool", "j14_stored_panels", "j14_one_panel"):
        df = QUERIES[name](spark, str(tmp_path))
        assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0], name
        got = df.collect()
        assert len(got) == 36 and {(r.lat, r.lon, r.elev, r.indiv) for r in got} == {(30.0, -100.0, 1234.0, "SMALL_0")}


def test_site_without_coordinates_in_some_rows_brings_them(spark):
    p = PLANTS
    row = lambda i, lat, lon, year: (1, lat, lon, 100.0, "NY", "oak", "Forb", i, 1, year, 90 + i)
    prior = spark.createDataFrame([row(1, 40.0, -75.0, 2020), row(2, None, None, 2021), row(3, 60.0, -75.0, 2022)], COLUMNS)
    cur = spark.createDataFrame([row(9, 40.1, -75.0, 2025)], COLUMNS)
    got = pool.neighbour_pool(cur, prior, p, carry=("id",))
    assert sorted((r.cur_id, r.id) for r in got.collect()) == [(9, 1), (9, 2), (9, 3)]


def test_days_of_panels_without_broadcast(spark, rows):
    """Several panels of one place, one panel of two rows, gaps; written flags, as small as their files are."""
    prior = [r for r in make(3, 400, **CASES["equator"]) if r[5] is not None and r[8] is not None]
    prior = [(*r[:9], 2015, r[10]) for r in prior]
    cur = [(*r[:9], 2025, r[10]) for r in prior[:30]]
    panels = [f"panel {i % 25}" for i in range(30)] + ["twin", None]
    cur += [cur[0], cur[1]]
    flags = staged(spark.createDataFrame([(*r, q) for r, q in zip(cur, panels)], COLUMNS + ", panel string"), "flags")
    df = anomaly.panel_days(flags, spark.createDataFrame(prior, COLUMNS), PLANTS)
    want = Counter((c[8], q, r[10]) for c, q in zip(cur, panels) for r in brute_pool(c, prior, PLANTS)[1])
    key = lambda r: str(r)
    assert sorted(rows(df), key=key) == sorted(((*k, n) for k, n in want.items()), key=key)
    assert any(n > 1 for n in want.values()) and len({k[1] for k in want}) > 10
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
