"""Raster cells, polygon edges and county tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafclock import schemas


def read_cells(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Yearly grids as one long table; the year is the start of the file name.

    Files of the not yet resampled current-year product (``ncep_``) are skipped.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (
        spark.read.schema(schemas.CELLS)
        .option("nullValue", "NA")
        .csv(path, header=True, recursiveFileLookup=True)
        .withColumn("file", name)
        .where(~F.col("file").contains("ncep_"))
        .select(
            F.lit(index).alias("index"),
            F.left("file", F.lit(4)).cast("int").alias("year"),
            "row", "col", "lon", "lat", "value",
        )
    )


def store_cells(cells: DataFrame, path: str) -> DataFrame:
    """The cell table as Parquet in a folder per index and year, and read back.

    A filter on index or year then opens only those folders; file names of yearly grids
    are looked at once, when they come in.
    """
    cells.hint("rebalance", "index", "year").write.partitionBy("index", "year").parquet(path)
    return cells.sparkSession.read.parquet(path).select(*cells.columns)


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Ring vertices -> directed edges; the last vertex closes the ring.

    A ring is one outline of one polygon, so the window never spans more than that.
    """
    ring = Window.partitionBy("poly_id", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("x", "y")]
    return (
        vertices.select(
            "poly_id", "ring_id", F.col("x").alias("x1"), F.col("y").alias("y1"),
            nxt[0].alias("x2"), nxt[1].alias("y2"),
        )
        .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def read_polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    return polygon_edges(spark.read.schema(schemas.VERTICES).csv(path, header=True))


def read_county_index(spark: SparkSession, path: str, years) -> DataFrame:
    """Wide county table from CSV; code columns keep their leading zeros."""
    return (
        spark.read.schema(schemas.county_index(years))
        .option("nullValue", "NA")
        .csv(path, header=True)
    )
