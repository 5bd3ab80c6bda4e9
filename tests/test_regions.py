"""Region files: several parts, holes, null shapes, attributes, and writers that die."""

import datetime
import os
import struct

import numpy as np
import pytest

from leafclock.sources import regions
from leafclock.sources.grids import polygon_edges

SCHEMA = "name string, code long, area double, coast boolean, seen date, rings array<array<struct<x:double,y:double>>>"
SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
ISLAND = [(-7.25, 51.0), (-7.0, 52.5), (1e-9, 51.125)]
ROWS = [
    ("Åland", 7, 1.5, True, datetime.date(2024, 2, 29), [SQUARE, HOLE, ISLAND]),
    ("none", -3, -2.2250738585072014e-308, False, datetime.date(1999, 12, 31), None),
    (None, None, None, None, None, [ISLAND]),
    ("no rings", 999_999_999_999_999_999, 0.1, True, None, []),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    """Rows without their places, points as tuples."""
    out = []
    for r in df.drop("file", "record").collect():
        *values, rings = r
        out.append((*values, None if rings is None else [[tuple(p) for p in ring] for ring in rings]))
    return sorted(out, key=str)


def test_written_files_read_back(spark, tmp_path):
    path = str(tmp_path / "r")
    regions.write_regions(table(spark).repartition(3), path)
    got = regions.read_regions(spark, path)
    assert got.columns == ["file", "record", "name", "code", "area", "coast", "seen", "rings"]
    assert [f.dataType.simpleString() for f in got.schema[2:7]] == ["string", "bigint", "double", "boolean", "date"]
    assert plain(got) == sorted(ROWS, key=str)
    assert not [n for n in os.listdir(path) if n.startswith(".part")]


def test_partitions_are_runs_of_records(spark, tmp_path):
    path = str(tmp_path / "r")
    many = [(f"n{i}", i, i / 7, None, None, [[(float(i), 0.0), (i + 1.0, 0.0), (i + 0.5, 1.0)]] * (i % 4)) for i in range(25)]
    regions.write_regions(table(spark, many).coalesce(1), path)
    got = regions.read_regions(spark, path, records=4)
    assert got.rdd.getNumPartitions() == 7
    assert plain(got) == sorted(many, key=str)
    assert sorted(r.record for r in got.collect()) == list(range(25))
    assert plain(regions.read_regions(spark, path, records=10, batch_bytes=1)) == sorted(many, key=str)
    rolled = str(tmp_path / "rolled")
    regions.write_regions(table(spark, many).coalesce(1), rolled, file_bytes=300)
    assert len([n for n in os.listdir(rolled) if n.endswith(".shp")]) > 5
    assert plain(regions.read_regions(spark, rolled)) == sorted(many, key=str)


def test_vertices_and_edges_as_from_the_vertex_table(spark, rows):
    import tempfile

    vertex_rows = [(k, ring, seq, x, y) for k, shape in (("A", [SQUARE, HOLE]), ("B", [ISLAND]))
                   for ring, points in enumerate(shape) for seq, (x, y) in enumerate(points)]
    vertices = spark.createDataFrame(vertex_rows, "poly_id string, ring_id int, seq int, x double, y double")
    with tempfile.TemporaryDirectory() as folder:
        regions.write_regions(regions.regions_of(vertices), folder)
        assert rows(regions.region_vertices(regions.read_regions(spark, folder), "poly_id")) == sorted(vertex_rows)
        assert rows(regions.read_region_edges(spark, folder, "poly_id")) == rows(polygon_edges(vertices))


def test_records_with_one_key_keep_their_rings_apart(spark, rows, tmp_path):
    path = str(tmp_path / "r")
    parts = [("A", 1, 0.0, True, None, [SQUARE, HOLE]), ("A", 2, 0.0, True, None, [ISLAND]), ("A", 3, 0.0, True, None, None)]
    regions.write_regions(table(spark, parts).coalesce(1), path)
    got = rows(regions.region_vertices(regions.read_regions(spark, path), "name"), "ring_id", "x", "y")
    assert {r[0] for r in got} == {0, 1, 2} and len(got) == 10
    assert sorted(r[1:] for r in got if r[0] == 2) == sorted(ISLAND)


def by_hand(path, kind, shapes, deleted=()):
    """Files as another program may write them: closed rings, a name that clashes, latin letters."""
    body, index = b"", b""
    for number, rings in enumerate(shapes, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in (*r, r[0])]
            starts = np.cumsum([0, *(len(r) + 1 for r in rings)])[:-1]
            content = struct.pack("<i4dii", kind, 0, 0, 0, 0, len(rings), len(points))
            content += struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
            content += struct.pack(f"<2d{len(points)}d", 0, 9, *range(len(points))) if kind != 5 else b""
        index += struct.pack(">ii", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">ii", number, len(content) // 2) + content
    for end, data in (("shp", body), ("shx", index)):
        head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8)
        with open(f"{path}.{end}", "wb") as f:
            f.write(head + data)
    columns = b"".join(struct.pack("<11sc4xBB14x", n, k, w, d) for n, k, w, d in
                       ((b"RECORD", b"C", 6, 0), (b"POP", b"N", 9, 0), (b"RATE", b"N", 8, 3)))
    rows = [(b"*" if k in deleted else b" ") + f"é{k}".encode("latin-1").ljust(6) + (b"*" * 9 if k == 1 else b"%9d" % k)
            + (b" " * 8 if k == 0 else b"%8.3f" % (k / 2)) for k in range(len(shapes))]
    with open(f"{path}.dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 99, 1, 1, len(rows), 33 + len(columns), 24) + columns + b"\r" + b"".join(rows))


@pytest.mark.parametrize("kind", [5, 15, 25])
def test_files_of_other_programs(spark, tmp_path, kind):
    by_hand(tmp_path / "us", kind, [[SQUARE, HOLE], None, [ISLAND], [SQUARE]], deleted=[3])
    got = regions.read_regions(spark, str(tmp_path / "us.shp"), encoding="latin-1")
    assert got.columns == ["file", "record", "RECORD_", "POP", "RATE", "rings"]
    found = {r.record: r for r in got.collect()}
    assert sorted(found) == [0, 1, 2], "the deleted row is left out"
    assert [found[k].RECORD_ for k in range(3)] == ["é0", "é1", "é2"]
    assert [found[k].POP for k in range(3)] == [0, None, 2] and [found[k].RATE for k in range(3)] == [None, 0.5, 1.0]
    assert [[tuple(p) for p in r] for r in found[0].rings] == [SQUARE, HOLE] and found[1].rings is None
    (tmp_path / "us.cpg").write_text("ISO-8859-1")
    assert regions.read_regions(spark, str(tmp_path / "us.shp")).first().RECORD_ == "é0"


def test_other_shapes_and_values_that_do_not_fit_fail(spark, tmp_path):
    by_hand(tmp_path / "points", 8, [[SQUARE]])
    with pytest.raises(Exception, match="not polygons"):
        regions.read_regions(spark, str(tmp_path / "points.shp")).collect()
    with pytest.raises(Exception, match="does not fit"):
        regions.write_regions(table(spark, [("x" * 255, *ROWS[0][1:])]), str(tmp_path / "long"))
    with pytest.raises(Exception, match="at most 10 bytes"):
        regions.write_regions(table(spark).withColumnRenamed("name", "a_longer_name"), str(tmp_path / "names"))


def test_only_committed_files_count(spark, tmp_path):
    path = str(tmp_path / "r")
    regions.write_regions(table(spark, ROWS[:1]), path)
    failing = table(spark, [ROWS[0]] * 3 + [("x" * 300, *ROWS[0][1:])]).repartition(4)
    with pytest.raises(Exception, match="does not fit"):
        regions.write_regions(failing, path)
    assert plain(regions.read_regions(spark, path)) == ROWS[:1]
    regions.write_regions(table(spark, ROWS[1:2]), path)
    assert plain(regions.read_regions(spark, path)) == sorted(ROWS[:2], key=str)
    regions.write_regions(table(spark, ROWS[2:]), path, mode="overwrite")
    assert plain(regions.read_regions(spark, path)) == sorted(ROWS[2:], key=str)


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    regions.write_regions(table(spark, []), str(tmp_path / "r"))
    assert regions.read_regions(spark, str(tmp_path / "r")).count() == 0
