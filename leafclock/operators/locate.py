"""Points in polygons by a cover of cells, on equi-joins only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafclock.sources.scratch import staged


@dataclass(frozen=True)
class Cover:
    """Each region's cells, in rows of cells of ``size`` degrees, and blocks of ``block`` cells along a row.

    ``spans`` (poly_id, row, block, first, last, run, odd) are runs of neighbouring cells:
    cells that no edge touches and that lie inside have no ``run``; cells that edges touch have
    one, and ``odd`` says whether what follows the run is inside. ``pieces`` (poly_id, row, run, x1,
    y1, x2, y2) are the edges of each run. Both are read
    from one written table.
    """

    spans: DataFrame
    pieces: DataFrame
    size: float
    block: int


def region_cover(edges: DataFrame, size: float = 0.05, block: int = 20) -> Cover:
    """The cover of the regions of ``poly_id, ring_id, x1, y1, x2, y2``.

    Every edge is cut at the rows of cells; what it touches there, with a little slack for rounding, is
    an interval of cells. Sorted along a row of a region, intervals that overlap or meet make a
    run, and the parity of the edges that have crossed the row's middle line says whether the
    untouched cells up to the next run are inside (holes and several parts come out
    right). A row is one sweep over its edges, so the work is linear in the edges and in the cells they touch.
    """
    slack = size * 1e-6
    cell = lambda v: F.floor(v / size).cast("int")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    at = lambda y: F.when(
        F.col("y1") != F.col("y2"),
        F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    begin = F.least(F.greatest(F.col("row") * F.lit(size), low), high)
    end = F.greatest(F.least((F.col("row") + 1) * F.lit(size), high), low)
    middle = (F.col("row") + 0.5) * F.lit(size)
    cut = edges.select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        cell(low - slack), cell(high + slack))).alias("row"))
    a, b = F.coalesce(at(begin), F.col("x1")), F.coalesce(at(end), F.col("x2"))
    cut = cut.select(
        "*", cell(F.least(a, b) - slack).alias("c0"), cell(F.greatest(a, b) + slack).alias("c1"),
        ((low <= middle) & (middle < high)).cast("int").alias("cross"))
    line, order = Window.partitionBy("poly_id", "row"), ["c0", "c1"]
    upto = line.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = line.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, so that the frame only grows.
    after = line.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("poly_id", "row", "run")
    cut = cut.withColumn("new", F.coalesce(F.col("c0") > F.max("c1").over(before) + 1, F.lit(True)))
    cut = cut.withColumns({"run": F.count_if("new").over(upto), "crossed": F.sum("cross").over(upto),
                           "next": F.min(F.when(F.col("new"), F.col("c0"))).over(after)})
    cut = cut.withColumns({"first": F.min("c0").over(run), "last": F.max("c1").over(run),
                           "odd": F.max("crossed").over(run) % 2 == 1})
    cut = staged(cut.select("poly_id", "row", "run", "x1", "y1", "x2", "y2", "new", "first", "last", "odd", "next"), "cover")
    # The first piece of a run stands for it, and for the gap behind it.
    own = F.struct("first", "last", "run", "odd")
    gap = F.struct((F.col("last") + 1).alias("first"), (F.col("next") - 1).alias("last"),
                   F.lit(None).cast("long").alias("run"), F.lit(True).alias("odd"))
    both = F.array_compact(F.array(own, F.when(F.col("odd") & F.col("next").isNotNull(), gap)))
    spans = cut.where("new").select("poly_id", "row", F.explode(both).alias("s")).select("poly_id", "row", "s.*")
    blocks = F.sequence(F.floor(F.col("first") / block).cast("int"), F.floor(F.col("last") / block).cast("int"))
    pieces = cut.select("poly_id", "row", "run", "x1", "y1", "x2", "y2")
    return Cover(spans.withColumn("block", F.explode(blocks)), pieces, size, block)


def place_points(points: DataFrame, cover: Cover) -> DataFrame:
    """(x, y, poly_id, row, run, odd) of points and the runs of cells they lie in.

    A point without ``run`` is inside; the others are in a cell that edges touch.
    """
    pts = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    col = F.floor(F.col("x") / cover.size).cast("int")
    pts = pts.withColumns({"row": F.floor(F.col("y") / cover.size).cast("int"), "col": col,
                           "block": F.floor(col / cover.block).cast("int")})
    return pts.join(cover.spans, ["row", "block"]).where("col BETWEEN first AND last").select(
        "x", "y", "poly_id", "row", "run", "odd")


def locate_points(points: DataFrame, edges: DataFrame, cover: Cover | None = None) -> DataFrame:
    """Pairs of point (``x, y``) and the polygon that holds it.

    ``edges`` has ``poly_id, ring_id, x1, y1, x2, y2``; their cover can be given. Points in cells that no
    edge touches are done. A point in a touched cell meets only the edges of its run of
    cells: those crossed to the east, and the parity behind the run, give an odd number inside. An edge's
    latitude range is half open, so a shared vertex counts once. The cover is
    written, so that a short one is broadcast and the points stay in place.
    """
    cover = cover or region_cover(edges)
    placed = place_points(points, cover)
    inside = placed.where(F.col("run").isNull()).select("x", "y", "poly_id")
    x_cross = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (
        F.col("y2") - F.col("y1")
    )
    between = (F.col("y") >= F.least("y1", "y2")) & (F.col("y") < F.greatest("y1", "y2"))
    crossed = F.when(between, (F.col("x") < x_cross).cast("int")).otherwise(F.lit(0))
    rim = (
        placed.join(cover.pieces, ["poly_id", "row", "run"])
        .groupBy("x", "y", "poly_id")
        .agg((F.sum(crossed) + F.first("odd").cast("int")).alias("crossings"))
        .where(F.col("crossings") % 2 == 1)
        .select("x", "y", "poly_id")
    )
    return inside.unionByName(rim)
