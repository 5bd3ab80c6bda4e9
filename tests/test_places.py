import math
import random

import pytest

from pyspark.sql import functions as F

from leafclock import PLANTS
from leafclock.operators import fill, locate, raster
from leafclock.operators.raster import CellGrid
from leafclock.sources.grids import polygon_edges, read_cells

V = "poly_id string, ring_id int, seq int, x double, y double"


def square(name, x0, y0, size=1.0, ring=0):
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    return [(name, ring, i, x0 + dx * size, y0 + dy * size) for i, (dx, dy) in enumerate(corners)]


def edges_of(spark, *polygons):
    return polygon_edges(spark.createDataFrame([v for p in polygons for v in p], V))


def test_polygons_with_holes_and_parts(spark, rows):
    edges = edges_of(
        spark, square("A", 0, 0, 4.0), square("A", 1, 1, 2.0, ring=1),
        square("A", 10, 10, 1.0, ring=2), square("B", 4, 0, 4.0),
    )
    pts = spark.createDataFrame(
        [(0.5, 0.5), (2.0, 2.0), (10.5, 10.5), (5.0, 2.0), (20.0, 2.0), (3.5, 1.0), (2.0, 0.0)],
        "x double, y double",
    )
    got = rows(locate.locate_points(pts, edges))
    # A point on a vertex's latitude counts once; the hole is outside.
    assert got == [(0.5, 0.5, "A"), (2.0, 0.0, "A"), (3.5, 1.0, "A"), (5.0, 2.0, "B"),
                   (10.5, 10.5, "A")]


def test_shared_borders_give_one_region(spark):
    edges = edges_of(spark, *[square(f"P{i}{j}", i, j) for i in range(4) for j in range(4)])
    rnd = random.Random(1)
    pts = [(round(rnd.uniform(0, 4), 1), round(rnd.uniform(0, 4), 1)) for _ in range(500)]
    pts = sorted({p for p in pts if p[0] < 4 and p[1] < 4})
    got = locate.locate_points(spark.createDataFrame(pts, "x double, y double"), edges).collect()
    assert {(r.x, r.y): r.poly_id for r in got} == {p: f"P{int(p[0])}{int(p[1])}" for p in pts}
    assert len(got) == len(pts)


def test_locate_uses_equi_joins(spark):
    edges = edges_of(spark, square("A", 0, 0))
    pts = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    plan = locate.locate_points(pts, edges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


OBS = "site_id long, lon double, lat double, state string, elev double"


def test_fill_state_and_elevation(spark, rows):
    p = PLANTS.with_(allowed_states=("CA", "NV"))
    edges = edges_of(spark, square("CA", 0, 0), square("NV", 1, 0), square("AK", 5, 5))
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, None, None), (2, 1.5, 0.5, "CA", 7.0), (3, 5.5, 5.5, None, 1.0),
         (4, 9.0, 9.0, None, 1.0), (5, 1.5, 0.5, None, 2.5), (5, 1.6, 0.5, None, None)], OBS,
    )
    filled = fill.fill_state(df, edges, p)
    assert rows(filled, "site_id", "state") == [(1, "CA"), (2, "CA"), (5, "NV"), (5, "NV")]
    lookup = spark.createDataFrame([(1, 2.5), (2, 3.5), (5, 9.4)], "site_id long, elevation double")
    assert rows(fill.fill_elevation(filled, lookup), "site_id", "elev") == [
        (1, 2.0), (2, 7.0), (5, 2.5), (5, 9.0)]
    assert rows(fill.fill_elevation(filled, lookup, overwrite=True), "site_id", "elev") == [
        (1, 2.0), (2, 4.0), (5, 9.0), (5, 9.0)]
    assert rows(fill.needs_elevation(df), "site_id") == [(1,), (5,)]


GRID = CellGrid(0.0, 4.0, 1.0, 4, 4)
C = "index string, year int, row int, col int, lon double, lat double, value double"


def cell_rows(values, year=2024, grid=GRID):
    return [("leaf", year, r, c, grid.x0 + (c + 0.5) * grid.res, grid.y0 - (r + 0.5) * grid.res, v)
            for (r, c), v in values.items()]


def all_cells(fn, grid=GRID):
    return {(r, c): fn(r, c) for r in range(grid.rows) for c in range(grid.cols)}


def test_coverage_and_zonal(spark):
    edges = edges_of(spark, square("A", 0.5, 1.0, 2.0))
    cells = spark.createDataFrame(cell_rows(all_cells(lambda r, c: 7.0)), C)
    cov = raster.coverage(edges, GRID)
    frac = {(r.row, r.col): r.frac for r in cov.collect()}
    # The square spans half of column 0, all of column 1, half of column 2, rows 1 and 2.
    assert frac == {(1, 0): 0.5, (1, 1): 1.0, (1, 2): 0.5, (2, 0): 0.5, (2, 1): 1.0, (2, 2): 0.5}
    z = raster.zonal(cells, cov).first()
    assert z["mean"] == 7.0 and z["count"] == 4.0


def test_coverage_is_exact(spark):
    """Shares add up to the area, whatever the rings' directions, beyond the grid and for slivers."""
    def ring(poly, ring_id, points):
        return [(poly, ring_id, i, float(x), float(y)) for i, (x, y) in enumerate(points)]

    outline = [(0.1, 0.1), (3.7, 0.4), (3.2, 3.9), (1.5, 2.2), (0.3, 3.1)]
    hole, island = [(1, 0.5), (2.5, 0.7), (1.7, 1.9)], [(1.5, 0.9), (1.9, 0.9), (1.7, 1.3)]
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    rows = ring("A", 0, outline) + ring("A", 1, hole) + ring("A", 2, island)
    rows += ring("B", 0, outline[::-1]) + ring("B", 1, hole) + ring("B", 2, island[::-1])
    rows += ring("thin", 0, [(0.5, 0.5), (3.5, 0.5), (3.5, 0.5001), (0.5, 0.5001)])
    rows += ring("wide", 0, [(-9, -9), (9, -9), (9, 9), (-9, 9)])
    rows += ring("left", 0, [(-5, 1), (1.5, 1), (-5, 3)])
    rows += ring("away", 0, [(50, 50), (60, 50), (60, 60)])
    edges = polygon_edges(spark.createDataFrame(rows, V))
    total = dict(raster.coverage(edges, GRID).groupBy("poly_id").agg(F.sum("frac")).collect())
    want = area(outline) - area(hole) + area(island)
    assert total["A"] == pytest.approx(want, abs=1e-9) and total["B"] == pytest.approx(want, abs=1e-9)
    assert total["thin"] == pytest.approx(3e-4, abs=1e-9) and total["wide"] == pytest.approx(16)
    assert total["left"] == pytest.approx(1.5 * (1.5 / 6.5 * 2) / 2, abs=1e-9) and "away" not in total


def test_zonal_ignores_missing_and_mask(spark):
    edges = edges_of(spark, square("A", 0.0, 0.0, 4.0))
    now = all_cells(lambda r, c: None if r == 0 else 10.0)
    cells = spark.createDataFrame(
        cell_rows(all_cells(lambda r, c: 5.0), 2023) + cell_rows(now, 2024), C
    )
    z = raster.zonal(cells, raster.coverage(edges, GRID))
    for min_prop, want in ((0.75, 10.0), (0.76, None)):
        got = {r.year: r for r in raster.mask_incomplete(z, 2024, min_prop).collect()}
        assert got[2023]["mean"] == 5.0 and got[2024]["mean"] == want
        assert got[2024]["frac"] == 0.75


def test_mask_without_coverage_last_year(spark):
    z = spark.createDataFrame(
        [("A", "leaf", 2023, None, 0.0), ("A", "leaf", 2024, 5.0, 2.0),
         ("B", "leaf", 2023, None, 0.0), ("B", "leaf", 2024, None, 0.0),
         ("C", "leaf", 2024, 5.0, 2.0)],
        "poly_id string, index string, year int, mean double, count double",
    )
    got = {r.poly_id: r["mean"] for r in raster.mask_incomplete(z, 2024).collect() if r.year == 2024}
    assert got == {"A": 5.0, "B": None, "C": None}


def test_resample_plane_and_gaps(spark):
    source = CellGrid(0.0, 4.0, 0.5, 8, 8)
    plane = all_cells(lambda r, c: 2.0 * c + 3.0 * r, source)
    cells = spark.createDataFrame(cell_rows(plane, grid=source), C)
    target = CellGrid(0.0, 4.0, 0.4, 10, 10)
    got = {(r.row, r.col): r.value for r in raster.resample(cells, source, target).collect()}
    assert len(got) == 100
    for (r, c), v in got.items():
        if 1 <= r <= 8 and 1 <= c <= 8:
            sc, sr = (c + 0.5) * 0.4 / 0.5 - 0.5, (r + 0.5) * 0.4 / 0.5 - 0.5
            assert abs(v - (2 * sc + 3 * sr)) < 1e-9
    hole = cells.where("NOT (row BETWEEN 3 AND 6 AND col BETWEEN 3 AND 6)")
    assert 64 < raster.resample(hole, source, target).count() < 100
    same = raster.resample(cells, source, source)
    assert {(r.row, r.col): r.value for r in same.collect()} == plane


def test_classes_close_on_the_right(spark, rows):
    df = spark.createDataFrame([(v,) for v in (-501.0, -500.0, -20.0, -19.9, 20.0, 20.1, 500.0,
                                               501.0, None)], "value double")
    got = [r["class"] for r in raster.classify(df, (-500.0, -20.0, 20.0, 500.0)).collect()]
    assert got == [None, 0, 0, 1, 1, 2, 2, None, None]
    labels = raster.classify(df, (-500.0, -20.0, 20.0, 500.0)).select(
        raster.class_label(F.col("class")).alias("l"))
    assert [r.l for r in labels.collect()][1:7] == ["Cool", "Cool", "Normal", "Normal", "Warm", "Warm"]


def test_value_at_point(spark, rows):
    cells = spark.createDataFrame(cell_rows(all_cells(lambda r, c: 10.0 * r + c)), C)
    pts = spark.createDataFrame([(1, 0.1, 3.9), (2, 3.9, 0.1), (3, 9.0, 9.0)],
                                "p int, lon double, lat double")
    assert rows(raster.value_at(cells, pts, GRID), "p", "value") == [(1, 0.0), (2, 33.0)]


def test_read_cells_by_file_name(spark, rows, tmp_path):
    for name, v in (("1999_si-x_leaf.csv", "4.5"), ("2000_si-x_leaf.csv", "NA"),
                    ("ncep_20000101_si-x_leaf.csv", "9")):
        (tmp_path / name).write_text(f"row,col,lon,lat,value\n0,1,-99.5,30.5,{v}\n")
    assert rows(read_cells(spark, str(tmp_path), "leaf"), "index", "year", "value") == [
        ("leaf", 1999, 4.5), ("leaf", 2000, None)]


def test_stored_cells_open_only_their_years(spark, rows, tmp_path):
    from leafclock.sources.grids import store_cells

    cells = spark.createDataFrame(
        cell_rows({(0, 0): 1.0, (1, 2): None}, 2023) + cell_rows({(0, 0): 3.0}, 2024), C)
    out = store_cells(cells, str(tmp_path / "cells"))
    assert rows(out) == rows(cells)
    plan = out.where("year = 2024 AND index = 'leaf'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan.split("PartitionFilters")[1][:200]


def test_polygons_and_layers_from_files(spark, rows, tmp_path):
    from leafclock.sources import observations
    from leafclock.sources.grids import read_polygon_edges

    spark.createDataFrame(square("A", 0, 0) + square("B", 2, 2, 3.0, ring=1), V).write.csv(
        str(tmp_path / "v"), header=True)
    assert rows(read_polygon_edges(spark, str(tmp_path / "v"))) == rows(
        edges_of(spark, square("A", 0, 0), square("B", 2, 2, 3.0, ring=1)))
    (tmp_path / "layers.csv").write_text("name,title,abstract,dimension_name\nx:a,A,NA,time\nx:b,B,t,NA\n")
    layers = observations.read_dimension(spark, str(tmp_path / "layers.csv"), "layers")
    assert rows(observations.layer_details(layers, "x:a")) == [("x:a", "A", None, "time")]
    (tmp_path / "classes.csv").write_text("id,name\n3,leaves\n")
    assert rows(observations.read_dimension(spark, str(tmp_path / "classes.csv"), "phase_classes")) == [(3, "leaves")]


def test_geometric_joins_place_no_exchange_by_hand(spark):
    points = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    plan = locate.locate_points(points, edges_of(spark, square("A", 0, 0)))
    assert "REPARTITION" not in plan._jdf.queryExecution().executedPlan().toString()


def test_points_deep_inside_meet_no_edges(spark):
    """Only points in cells that edges touch are compared, and only with the edges near them."""
    rnd = random.Random(4)
    n = 400
    ring = [("A", 0, i, 10 + (3 + 0.02 * rnd.random()) * math.cos(2 * math.pi * i / n),
             10 + (3 + 0.02 * rnd.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    island = [("A", k, i, 10 + 0.3 * (k - 3) + dx, 10.003 + dy) for k in range(1, 6)
              for i, (dx, dy) in enumerate(((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01)))]
    edges = polygon_edges(spark.createDataFrame(ring + island, V))
    pts = [(rnd.uniform(6, 14), rnd.uniform(6, 14)) for _ in range(1500)]
    pts += [(10 + 0.3 * (k - 3) + 0.005, 10.008) for k in range(1, 6)] + [(10.1, 10.008), (10.1, 11.0)]
    points = spark.createDataFrame(pts, "x double, y double")
    cover = locate.region_cover(edges)
    placed = locate.place_points(points, cover)
    rim = placed.where("run IS NOT NULL")
    compared = rim.join(cover.pieces, ["poly_id", "row", "run"]).count()
    deep = [p for p in pts if math.dist(p, (10, 10)) < 2.8 and abs(p[1] - 10) > 0.2]
    done = {(r.x, r.y) for r in placed.where("run IS NULL").collect()}
    assert len(deep) > 500 and done >= set(deep)
    assert rim.count() < 0.15 * len(pts) and compared < 25 * rim.count()
    got = {(r.x, r.y) for r in locate.locate_points(points, edges, cover).collect()}
    lines = [tuple(e)[2:] for e in edges.collect()]

    def inside(x, y):
        return sum(min(b, d) <= y < max(b, d) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in lines) % 2

    assert got == {p for p in pts if inside(*p)}


def test_cover_of_touching_slanted_and_flat_edges(spark):
    """Edges on the lines of the cells, flat ones, and one region within another's hole."""
    rnd = random.Random(8)
    shapes = [square("A", 0, 0, 1.0), square("A", 0.25, 0.25, 0.5, ring=1), square("B", 0.25, 0.25, 0.5),
              [("C", 0, i, x, y) for i, (x, y) in enumerate(((1.0, 0.0), (1.55, 0.0), (1.3, 0.35), (1.0, 0.1)))],
              [("D", 0, i, x, y) for i, (x, y) in enumerate(((-1.0, -1.0), (3.0, -0.9), (-1.0, -0.8)))]]
    edges = edges_of(spark, *shapes)
    pts = [(round(rnd.uniform(-1, 2), 2), round(rnd.uniform(-1, 1), 2)) for _ in range(1500)]
    pts += [(x, y) for x in (0.0, 0.25, 0.5, 0.75, 1.0) for y in (0.0, 0.25, 0.5, 0.75, 1.0)]
    got = {(r.x, r.y, r.poly_id) for r in locate.locate_points(
        spark.createDataFrame(pts, "x double, y double"), edges).collect()}
    want = set()
    lines = [tuple(e) for e in edges.collect()]
    for x, y in pts:
        for poly in "ABCD":
            n = sum(p == poly and min(b, d) <= y < max(b, d) and x < a + (y - b) * (c - a) / (d - b)
                    for p, _, a, b, c, d in lines)
            if n % 2:
                want.add((x, y, poly))
    assert got == want


def nested(spark, n, seed=2):
    """One outline with n islands' lakes in a band of latitude, some lakes with an isle."""
    rnd = random.Random(seed)
    rings = [("A", 0, [(0, 0), (n, 0), (n, 1), (0, 1)])]
    for i in range(n):
        size = 0.9 * 10 ** rnd.uniform(-4, 0)
        x, y = i + 0.05, 0.5 + rnd.uniform(-0.01, 0.01) - size / 2
        lake = [(x, y), (x + size, y + size / 9), (x + size / 2, y + size)]
        rings.append(("A", 2 * i + 1, lake[::rnd.choice((1, -1))]))
        if i % 3 == 0:
            cx, cy = (sum(c) / 3 for c in zip(*lake))
            rings.append(("A", 2 * i + 2, [(cx + (a - cx) / 4, cy + (b - cy) / 4) for a, b in lake][::rnd.choice((1, -1))]))
    rows = [(p, r, i, float(a), float(b)) for p, r, ring in rings for i, (a, b) in enumerate(ring)]
    return rings, polygon_edges(spark.createDataFrame(rows, V))


def test_nested_rings_by_a_sweep(spark):
    rings, edges = nested(spark, 300)
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
    got = {r.ring_id: r.sign for r in raster._ring_signs(edges).collect()}
    want = {r: (1 if area(p) > 0 else -1) * (-1 if r and r % 2 else 1) for _, r, p in rings}
    assert got == want
    # Rings that meet in a vertex, and rings of one shape side by side.
    touching = edges_of(spark, square("T", 0, 0, 3.0), square("T", 0, 1, 1.0, ring=1), square("T", 1, 2, 1.0, ring=2),
                        square("U", 0, 0), square("U", 1, 0, ring=1), square("U", 2, 0, ring=2))
    assert {(r.poly_id, r.ring_id): r.sign for r in raster._ring_signs(touching).collect()} == {
        ("T", 0): 1, ("T", 1): -1, ("T", 2): -1, ("U", 0): 1, ("U", 1): 1, ("U", 2): 1}


def test_islands_of_one_band_are_linear_work(spark):
    """Edges meet few lines: 20,000 islands in one band of latitude, not 20,000 times their edges."""
    n = 20_000
    i = spark.range(n).withColumns({"x": F.col("id") % 2000 * 0.01, "y": F.floor(F.col("id") / 2000) * 0.004})
    corners = [(0, 0), (0.006, 0.0005), (0.006, 0.003), (0.001, 0.0035)]
    edges = None
    for k, (a, b) in enumerate(corners):
        c, d = corners[(k + 1) % 4]
        part = i.select(F.lit("A").alias("poly_id"), F.col("id").cast("int").alias("ring_id"), (F.col("x") + a).alias("x1"),
                        (F.col("y") + b).alias("y1"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2"))
        edges = part if edges is None else edges.unionByName(part)
    rings = edges.groupBy("poly_id", "ring_id").agg(F.min("y1").alias("low"))
    level = F.lit(3)
    tested = rings.select("poly_id", "ring_id", level.alias("level"), raster._line_of(F.col("low"), level).alias("line"))
    assert raster._crossings(edges, tested).count() < 4 * n
    assert raster._ring_signs(edges).groupBy("sign").count().collect()[0][:] == (1.0, n)


def test_zonal_years_are_computed_once(spark, rows, tmp_path):
    import shutil

    from leafclock.operators.zonal_store import coverage_version, zonal_years
    from leafclock.sources.grids import store_cells

    edges = edges_of(spark, square("A", 0.5, 1.0, 2.0), square("B", 2.5, 1.0, 1.2))
    cov = raster.coverage(edges, GRID)
    values = [cell_rows(all_cells(lambda r, c: None if (r + c + y) % 5 == 0 else r * 4.0 + c + y), 2020 + y) for y in range(5)]
    folder, store = str(tmp_path / "cells"), str(tmp_path / "store")
    cells = store_cells(spark.createDataFrame([x for v in values for x in v], C), folder)
    whole = rows(raster.zonal(cells, cov))
    past, now = [("leaf", 2020 + y) for y in range(4)], [("leaf", 2024)]
    some = zonal_years(cells, cov, store, past[:2])
    assert rows(some) == [r for r in whole if r[2] < 2022]
    assert rows(zonal_years(cells, cov, store, past, now)) == whole
    other = raster.coverage(edges_of(spark, square("A", 0.5, 1.0, 2.0), square("B", 2.5, 1.0, 1.3)), GRID)
    changed = rows(raster.zonal(cells, other))
    # Cells of past years are gone: whoever opens them fails, or lacks rows.
    kept = {y: str(tmp_path / f"kept-{y}") for y in range(2020, 2024)}
    for y, to in kept.items():
        shutil.move(f"{folder}/index=leaf/year={y}", to)
    left = spark.read.schema(cells.schema).parquet(folder)
    again = zonal_years(left, cov, store, past, now)
    assert rows(again) == whole
    stored = zonal_years(left, cov, store, past)
    assert "/cells" not in "".join(stored.inputFiles())
    # Another coverage is another version: all its years are computed.
    assert coverage_version(cov) == coverage_version(cov.repartition(3)) != coverage_version(other)
    for y, to in kept.items():
        shutil.move(to, f"{folder}/index=leaf/year={y}")
    assert rows(zonal_years(store_cells(cells, str(tmp_path / "again")), other, store, past, now)) == changed
    assert rows(zonal_years(cells, cov, store, past, now)) == whole


def test_resampling_moves_cells_and_halos_only(spark, tmp_path):
    source = CellGrid(0.0, 40.0, 0.1, 400, 400)
    target = CellGrid(0.0, 40.0, 0.08, 500, 500)
    cells = spark.range(160_000).select(
        F.lit("leaf").alias("index"), F.lit(2024).alias("year"), F.floor(F.col("id") / 400).cast("int").alias("row"),
        (F.col("id") % 400).cast("int").alias("col"), (F.col("id") % 400 * 2.0 + F.floor(F.col("id") / 400) * 3.0).alias("value"))
    cells.write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    moved = raster._tiled(cells, source, target, 64).count()
    assert moved < 160_000 * 1.12
    out = raster.resample(cells, source, target)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    wrong = F.abs(F.col("value") - ((F.col("col") + 0.5) * 0.8 - 0.5) * 2 - ((F.col("row") + 0.5) * 0.8 - 0.5) * 3) > 1e-6
    inner = F.col("row").between(1, 498) & F.col("col").between(1, 498)
    assert out.where(inner & wrong).isEmpty() and out.count() == 250_000
    whole = {tuple(r) for r in out.where("row < 70 AND col < 70").select("row", "col", F.round("value", 6)).collect()}
    small = raster.resample(cells, source, target, tile=7).where("row < 70 AND col < 70")
    assert whole == {tuple(r) for r in small.select("row", "col", F.round("value", 6)).collect()}
