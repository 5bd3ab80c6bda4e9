import random

import pyarrow as pa

from leafclock import PLANTS
from leafclock.functions import bands
from leafclock.operators import pool, state
from leafclock.plans.anomalies import split
from tests.test_pool import COLUMNS


def group(seed, n_keys=60, n_rows=300):
    rnd = random.Random(seed)
    spots = [(40.0, -90.0), (40.1, -90.1)]
    keys = [("oak", 1, *rnd.choice(spots), float(rnd.randint(0, 300))) for _ in range(n_keys)]
    rows = [(*rnd.choice([(None, None), *spots]), float(rnd.randint(0, 300)), rnd.choice([None, *range(5)]),
             rnd.choice([None, *range(9)]), rnd.randint(1, 3), rnd.randint(1, 7)) for _ in range(n_rows)]
    names = ["common_name", "pheno_class_id", "lat", "lon", "elev"]
    table = pa.table(dict(zip(["lat", "lon", "u_elev", "unit", "first_yes", "n", "years_0"], map(list, zip(*rows)))))
    return keys, rows, pa.table(dict(zip(names, map(list, zip(*keys))))), table


def held(key, rows, band):
    return [r for r in rows if r[0] in (None, key[2]) and abs(r[2] - key[4]) < band]


def test_windows_count_what_each_key_holds(monkeypatch):
    monkeypatch.setattr(bands, "CHUNK", 7)
    for seed in range(4):
        keys, rows, key_table, row_table = group(seed)
        got = bands.individuals(key_table, row_table, 30.0).to_pylist()
        want = [(*k, len({r[3] for r in held(k, rows, 30.0)})) for k in keys]
        assert sorted(tuple(r.values()) for r in got) == sorted(w for w in want if w[-1])
        got = bands.summaries(key_table, row_table, 30.0, {"q25": 0.25}, 3, 63).to_pylist()
        want = []
        for k in keys:
            some = held(k, rows, 30.0)
            days = [r[4] for r in some if r[4] is not None]
            years = [y for y in range(3) if any(r[6] >> y & 1 for r in some)]
            want += [(*k, sum(r[5] for r in some), len(years), min(days, default=None))] if some else []
        key = lambda r: tuple(-1 if v is None else v for v in r)
        assert sorted((tuple(r.values())[:-1] for r in got), key=key) == sorted(want, key=key)


def records(year, ids, elev):
    return [(i, 40.0, -90.0, float(elev(i)), "S1", "oak", "Forb", i, 1, year, 100 + i % 9) for i in ids]


def test_rows_reach_a_tile_once_not_each_of_its_keys(spark):
    cur = spark.createDataFrame(records(PLANTS.year, range(200), lambda i: i), COLUMNS)
    prior = spark.createDataFrame(records(2020, range(300), lambda i: 900 + i), COLUMNS)
    keys, counts = pool._pool_keys(cur, PLANTS), pool._day_counts(prior, PLANTS)
    reach = pool._counts_of(counts, None, keys, pool._near_areas(keys, counts, PLANTS), PLANTS)
    assert reach.count() == 300


def test_working_tables_of_pools_are_not_broadcast(spark):
    cur = spark.createDataFrame(records(PLANTS.year, range(40), lambda i: i), COLUMNS)
    prior = spark.createDataFrame(records(2020, range(40), lambda i: i), COLUMNS)
    # Spark would broadcast tables this small; only the list of species and phases may be.
    plan = pool.pool_sizes(cur, prior, PLANTS)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 2


def test_both_sides_read_the_rows_written_once(spark):
    rows = records(PLANTS.year, range(5), float) + records(2020, range(5), float)
    cur, prior = split(spark.createDataFrame(rows, COLUMNS), PLANTS)
    assert (cur.count(), prior.count()) == (5, 5)
    assert all("leafclock-observations" in f or "leafclock-keys" in f for f in prior.inputFiles())


def test_labels_of_panels_are_made_before_rows_are_copied(spark):
    prior = spark.createDataFrame(records(2020, range(5), float), COLUMNS)
    flags = spark.createDataFrame([("S1", "oak", 1, "oak (S1)"), ("S2", "oak", 1, "oak (S2)")],
                                  "state string, common_name string, pheno_class_id int, panel string")
    out = state.state_panels(prior, flags, PLANTS)
    assert out.count() == 15 and {r.state_spp_ph for r in out.collect()} == {"S1_oak_1"}
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [len(x) - len(x.lstrip(" :+-")) for x in lines if "AS state_spp#" in x and "Project" in x]
    joins = [len(x) - len(x.lstrip(" :+-")) for x in lines if "Join" in x]
    assert len(made) == len(joins) == 2 and min(made) > min(joins)
