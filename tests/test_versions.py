"""The cache of prior years through merges, crashes and rival writers."""

import os

import pytest

from leafclock import schemas
from leafclock.operators import refresh
from leafclock.sources.sinks import write_report_table
from leafclock.sources.versions import MERGED, Batches, Version


def add(spark, path, name, years, site=1):
    rows = [(site, 40.0, -90.0, 1.0, "CA", "oak", 7, "Forb", i, "Leaves", c, y, 5, 1) for y in years for c in (1, 3) for i in range(3)]
    refresh._write(spark.createDataFrame(rows, schemas.PLANTS), Batches(spark, path).folder(name))


@pytest.fixture
def cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    for k in range(5):
        add(spark, path, f"b{k}", [2010 + k, 2011 + k], site=k)
    return path


def test_merging_keeps_the_rows(spark, rows, cache):
    before = rows(refresh.read_cache(spark, cache))
    batches = Batches(spark, cache)
    assert len(before) == 60 and batches.live() == [f"b{k}" for k in range(5)]
    assert rows(refresh.compact_cache(spark, cache)) == before
    (merged,) = batches.live()
    assert merged.startswith(MERGED) and batches.version().number == 1
    add(spark, cache, "b5", [2020])
    assert len(rows(refresh.read_cache(spark, cache))) == 66
    assert rows(refresh.compact_cache(spark, cache, least=3)) == rows(refresh.read_cache(spark, cache))
    assert len(batches.live()) == 2, "two batches are fewer than three"
    assert len(rows(refresh.compact_cache(spark, cache, least=2))) == 66
    assert len(batches.live()) == 1 and all(batches.finished(f"b{k}") for k in range(6))


def test_full_batches_are_left_alone(spark, rows, cache):
    add(spark, cache, "large", range(1900, 2000))
    batches = Batches(spark, cache)
    full = batches.size("large")
    assert full > max(batches.size(f"b{k}") for k in range(5))
    before = rows(refresh.read_cache(spark, cache))
    assert rows(refresh.compact_cache(spark, cache, full_bytes=full)) == before
    assert "large" in batches.live() and len(batches.live()) == 2


def test_a_reader_from_before_the_switch_finishes(spark, rows, cache):
    early = refresh.read_cache(spark, cache)
    refresh.compact_cache(spark, cache)
    assert Batches(spark, cache).vacuum(hours=1) == [], "a reader has time to finish"
    assert early.count() == 60
    gone = Batches(spark, cache).vacuum(hours=0)
    assert sorted(gone) == [f"b{k}" for k in range(5)] and not os.path.exists(f"{cache}/batch=b0")
    assert refresh.read_cache(spark, cache).count() == 60
    assert Batches(spark, cache).vacuum(hours=0) == []


def test_dying_between_write_and_switch_changes_nothing(spark, rows, cache, monkeypatch):
    before = rows(refresh.read_cache(spark, cache))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Batches, "commit", die)
        with pytest.raises(RuntimeError):
            refresh.compact_cache(spark, cache)
    batches = Batches(spark, cache)
    assert any(b.startswith(MERGED) for b in batches._marked()) and batches.version() == Version()
    assert rows(refresh.read_cache(spark, cache)) == before
    assert rows(refresh.compact_cache(spark, cache)) == before
    assert len([b for b in batches.vacuum(hours=0) if b.startswith(MERGED)]) == 1
    assert rows(refresh.read_cache(spark, cache)) == before


def test_of_two_rivals_one_wins(spark, rows, cache):
    before = rows(refresh.read_cache(spark, cache))
    batches = Batches(spark, cache)
    base = batches.version()
    assert rows(refresh.compact_cache(spark, cache)) == before
    assert not batches.commit(base, {"b0": "merged-mine"})
    assert batches.version().number == 1 and rows(refresh.read_cache(spark, cache)) == before
    assert not [f for f in os.listdir(f"{cache}/_versions") if f.startswith(".") and not f.endswith(".crc")]


def test_batches_added_during_a_merge_stay(spark, rows, cache, monkeypatch):
    write = refresh._write

    def slow(df, target):
        write(df, target)
        if MERGED in target:
            monkeypatch.setattr(refresh, "_write", write)
            add(spark, cache, "late", [2030])

    monkeypatch.setattr(refresh, "_write", slow)
    assert refresh.compact_cache(spark, cache).count() == 66
    assert "late" in Batches(spark, cache).live()


def test_a_report_replaces_the_same_days(spark, tmp_path):
    for value in (1, 2):
        path = write_report_table(spark.createDataFrame([(value,)], "v int"), str(tmp_path), "20250204", 2009)
    assert [r.v for r in spark.read.csv(path, header=True).collect()] == ["2"]
