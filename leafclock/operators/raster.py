"""Raster work on a long cell table: one row per index, year and cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafclock.params import ANOMALY_CLASSES
from leafclock.sources.scratch import staged


@dataclass(frozen=True)
class CellGrid:
    """Regular grid: upper left corner, cell size, extent in cells."""

    x0: float
    y0: float
    res: float
    rows: int
    cols: int

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.y0) - lat) / self.res).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.x0)) / self.res).cast("int")

    def lon(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.res

    def lat(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.res

    def holds(self) -> Column:
        return F.col("row").between(0, self.rows - 1) & F.col("col").between(0, self.cols - 1)


#: Lines of latitude by level: ``16 ** -level`` degrees apart, off the round numbers that vertices like.
_STEP, _OFF = 16, 0.3819660113


def _line_of(y: Column, level: Column) -> Column:
    """Number of the first line of a level at or above a latitude."""
    return F.ceil(y * F.pow(F.lit(float(_STEP)), level) - F.lit(_OFF)).cast("long")


def _nodes(first: Column, end: Column) -> Column:
    """The fewest dyadic intervals (j, node) that make up the line numbers [first, end).

    ``node`` at j holds the lines with ``line >> j = node``; there are two of each j at most.
    """
    def at(j):
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1, j)
        high = F.call_function("shiftright", end, j)
        some = low < high
        return F.array(
            F.when(some & (low % 2 != 0), F.struct(j.alias("j"), low.alias("node"))),
            F.when(some & (high % 2 != 0), F.struct(j.alias("j"), (high - 1).alias("node"))))

    most = F.ceil(F.log2(F.greatest(end - first, F.lit(1)).cast("double"))).cast("int") + 1
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), most), at)))


def _ring_signs(edges: DataFrame, close: float = 1e-9) -> DataFrame:
    """+1 or -1 per ring: what turns its signed area into land, or into a hole of it.

    A ring is a hole if an odd number of the other rings of its polygon lie around it. Every
    ring is tested on one line of latitude, of a level whose lines are less than half its height apart, just
    right of where the line first meets the ring: one sweep along the line counts the
    edges met so far. Edges find the lines in use by dyadic intervals, so an edge meets only lines
    that cross it, and rings of like size share lines: the work is linear in the edges but for a logarithm.
    Edges that meet the line within ``close`` of one another count as met together.
    """
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    rings = edges.where("x1 <> x2 OR y1 <> y2").groupBy("poly_id", "ring_id").agg(
        area.alias("area"), F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"),
    ).where("area <> 0")
    rings = staged(rings.withColumn("others", F.count("*").over(Window.partitionBy("poly_id")) - 1), "rings")
    level = F.greatest(F.ceil(-F.log(float(_STEP), (F.col("high") - F.col("low")) / 2)), F.lit(0)).cast("int")
    # The only ring of a polygon lies in no other.
    tested = rings.where("others > 0").withColumn("level", level)
    tested = tested.select("poly_id", "ring_id", "level", _line_of(F.col("low"), F.col("level")).alias("line"))
    crossings = _crossings(edges, tested)
    crossings = crossings.withColumn("at", F.round(F.col("x") / close).cast("long"))
    line = Window.partitionBy("poly_id", "level", "line").orderBy("at")
    own = Window.partitionBy("poly_id", "level", "line", "ring_id").orderBy("at")
    met = F.count("*").over(line.rangeBetween(Window.unboundedPreceding, 1))
    mine = F.count("*").over(own.rangeBetween(Window.unboundedPreceding, 1))
    first = F.row_number().over(own)
    depth = crossings.withColumns({"around": met - mine, "nth": first}).where("nth = 1").join(
        tested, ["poly_id", "ring_id", "level", "line"], "left_semi").select("poly_id", "ring_id", "around")
    hole = F.coalesce(F.col("around"), F.lit(0)) % 2 == 1
    return rings.join(depth, ["poly_id", "ring_id"], "left").select(
        "poly_id", "ring_id", (F.signum("area") * F.when(hole, -1).otherwise(1)).alias("sign"))


def _crossings(edges: DataFrame, tested: DataFrame) -> DataFrame:
    """(poly_id, ring_id, level, line, x) where edges cross the lines that rings are tested on."""
    lines = tested.select("poly_id", "level", "line").distinct()
    up = lines.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn(
        "node", F.call_function("shiftright", F.col("line"), F.col("j")))
    levels = lines.select("poly_id", "level").distinct()
    begin, end = (_line_of(f("y1", "y2"), F.col("level")) for f in (F.least, F.greatest))
    cut = edges.where("y1 <> y2").join(levels, "poly_id").withColumns({"begin": begin, "end": end}).where("begin < end")
    cut = cut.select("poly_id", "ring_id", "level", "x1", "y1", "x2", "y2", F.inline(_nodes(F.col("begin"), F.col("end"))))
    y = (F.col("line") + F.lit(_OFF)) / F.pow(F.lit(float(_STEP)), F.col("level"))
    share = F.least(F.greatest((y - F.col("y1")) / (F.col("y2") - F.col("y1")), F.lit(0.0)), F.lit(1.0))
    return cut.join(up, ["poly_id", "level", "j", "node"]).select(
        "poly_id", "ring_id", "level", "line", (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"))


def coverage(edges: DataFrame, grid: CellGrid, least: float = 1e-9) -> DataFrame:
    """Exact share of each cell inside each region: (poly_id, row, col, frac).

    Every edge is cut at the lines of the grid. A piece adds the area to its right within
    its cell, and its height to all cells further right in the row; a running sum along
    the row gives every cell's share, and cells between two pieces have one share. A row
    of a region has at most two rows per column to sort. Shares below ``least`` are
    rounding. The grid is the same for all years, so this runs once.
    """
    u = lambda x: (F.col(x) - F.lit(grid.x0)) / grid.res
    v = lambda y: (F.lit(grid.y0) - F.col(y)) / grid.res
    cut = edges.select("poly_id", "ring_id", u("x1").alias("u1"), v("y1").alias("v1"),
                       u("x2").alias("u2"), v("y2").alias("v2")).where("v1 <> v2")
    top, bottom = F.least("v1", "v2"), F.greatest("v1", "v2")
    first, last = F.greatest(F.floor(top), F.lit(0)), F.least(F.ceil(bottom) - 1, F.lit(grid.rows - 1))
    at = lambda w: F.col("u1") + (w - F.col("v1")) / (F.col("v2") - F.col("v1")) * (F.col("u2") - F.col("u1"))
    low, high = F.greatest(top, F.col("row")), F.least(bottom, F.col("row") + 1)
    rows = (
        cut.where(first <= last)
        .withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .select("poly_id", "ring_id", "row", at(low).alias("a"), at(high).alias("b"),
                ((high - low) * F.signum(F.col("v2") - F.col("v1"))).alias("dv"))
        .where("dv <> 0")
    )
    left, right = F.least("a", "b"), F.greatest("a", "b")
    # All that lies left of the grid is one column, -1; what lies right of it has no effect.
    begin = F.greatest(F.floor(left), F.lit(-1)).cast("int")
    end = F.least(F.greatest(F.floor(right), F.lit(-1)), F.lit(grid.cols - 1)).cast("int")
    lo = F.when(F.col("col") < 0, left).otherwise(F.greatest(left, F.col("col")))
    hi = F.least(right, F.col("col") + 1)
    share = F.when(right > left, (hi - lo) / F.nullif(right - left, F.lit(0.0))).otherwise(F.lit(1.0))
    pieces = (
        rows.where(begin <= end)
        .withColumn("col", F.explode(F.sequence(begin, end)))
        .withColumn("height", F.col("dv") * share)
        .withColumn("area", F.col("height") * (1 - ((lo + hi) / 2 - F.col("col"))))
    )
    signed = pieces.groupBy("poly_id", "ring_id", "row", "col").agg(
        F.sum("height").alias("height"), F.sum("area").alias("area"))
    signed = signed.join(_ring_signs(edges), ["poly_id", "ring_id"]).groupBy("poly_id", "row", "col").agg(
        F.sum(F.col("height") * F.col("sign")).alias("height"), F.sum(F.col("area") * F.col("sign")).alias("area"))
    along = Window.partitionBy("poly_id", "row").orderBy("col")
    upto = F.sum("height").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.coalesce(F.lead("col").over(along), F.lit(grid.cols))
    runs = signed.withColumn("upto", upto).withColumn("next", nxt)
    own = runs.select("poly_id", "row", "col", (F.col("upto") - F.col("height") + F.col("area")).alias("frac"))
    between = runs.where((F.col("col") + 1 < F.col("next")) & (F.abs("upto") > least)).select(
        "poly_id", "row", F.explode(F.sequence(F.col("col") + 1, F.col("next") - 1)).alias("col"), F.col("upto").alias("frac"))
    # Rows count downwards, so land comes out with one sign everywhere.
    frac = F.least(F.abs("frac"), F.lit(1.0))
    return own.unionByName(between).withColumn("frac", frac).where((F.col("col") >= 0) & (F.col("frac") > least))


def zonal_sums(cells: DataFrame, cov: DataFrame) -> DataFrame:
    """Coverage-weighted sum of values and sum of coverage per region, index and year."""
    w, v = F.col("frac"), F.col("value")
    return cells.join(cov, ["row", "col"]).groupBy("poly_id", "index", "year").agg(
        F.sum(v * w).alias("vw"), F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)).alias("count"))


def zonal_means(sums: DataFrame) -> DataFrame:
    mean = F.when(F.col("count") > 0, F.col("vw") / F.col("count"))
    return sums.select("poly_id", "index", "year", mean.alias("mean"), "count")


def zonal(cells: DataFrame, cov: DataFrame) -> DataFrame:
    """Coverage-weighted mean and coverage sum per region, index and year, over
    cells that have a value."""
    return zonal_means(zonal_sums(cells, cov))


def mask_incomplete(z: DataFrame, year: int, min_prop: float = 0.90) -> DataFrame:
    """Blank the current mean of regions whose coverage is below a share of last year's.

    A region has one row per year, so the window is as short as the series.
    """
    region = Window.partitionBy("poly_id", "index")
    last = F.max(F.when(F.col("year") == year - 1, F.col("count"))).over(region)
    count, before = F.col("count"), F.col("last_count")
    # Coverage where there was none before is complete; none twice is unknown.
    ratio = F.when(before > 0, count / before).when((before == 0) & (count > 0), float("inf"))
    frac = F.when(F.col("year") == year, ratio)
    return (
        z.withColumn("last_count", last)
        .withColumn("frac", frac)
        .withColumn(
            "mean",
            F.when(F.col("year") != year, F.col("mean")).when(
                F.col("frac") >= min_prop, F.col("mean")
            ),
        )
        .drop("last_count")
    )


def _tiled(cells: DataFrame, source: CellGrid, target: CellGrid, tile: int) -> DataFrame:
    """Source cells with a value, once for each tile of target cells that they can touch.

    (index, year, t_row, t_col, value, sx, sy, r0, r1, c0, c1), with the target rows and columns within
    the tile. Only cells near the border of a tile go to several: its halo.
    """
    reach = source.res
    v = cells.where(F.col("value").isNotNull()).select(
        "index", "year", "value",
        source.lon(F.col("col")).alias("sx"), source.lat(F.col("row")).alias("sy"),
    )
    # A hair of slack each way for rounding; cells without weight are dropped below.
    hair = target.res * 1e-6
    v = v.withColumns({
        "r0": F.greatest(target.row(F.col("sy") + reach + hair), F.lit(0)),
        "r1": F.least(target.row(F.col("sy") - reach - hair), F.lit(target.rows - 1)),
        "c0": F.greatest(target.col(F.col("sx") - reach - hair), F.lit(0)),
        "c1": F.least(target.col(F.col("sx") + reach + hair), F.lit(target.cols - 1)),
    }).where("r0 <= r1 AND c0 <= c1")

    def tiles(low, high):
        at = lambda c: F.floor(F.col(c) / tile).cast("int")
        return F.explode(F.sequence(at(low), at(high)))

    v = v.withColumn("t_row", tiles("r0", "r1")).withColumn("t_col", tiles("c0", "c1"))
    inside = {}
    for low, high, t in (("r0", "r1", "t_row"), ("c0", "c1", "t_col")):
        inside[low] = F.greatest(F.col(low), F.col(t) * tile)
        inside[high] = F.least(F.col(high), (F.col(t) + 1) * tile - 1)
    return v.withColumns(inside)


def resample(cells: DataFrame, source: CellGrid, target: CellGrid, tile: int = 64) -> DataFrame:
    """Bilinear values at the centres of another grid.

    The target is cut into tiles. Each source cell goes to its tile, and cells of a tile's halo
    to both sides, in one exchange; a tile's task then spreads them over its target cells and
    sums, so nothing else is moved. A tile holds a bounded number of cells. Weights are renormalised over
    neighbours that have a value.
    """
    tiled = _tiled(cells, source, target, tile).repartition("index", "year", "t_row", "t_col")
    spread = (
        tiled.withColumn("row", F.explode(F.sequence("r0", "r1")))
        .withColumn("col", F.explode(F.sequence("c0", "c1")))
        .withColumns({"lon": target.lon(F.col("col")), "lat": target.lat(F.col("row"))})
    )
    wx = 1 - F.abs(F.col("lon") - F.col("sx")) / source.res
    wy = 1 - F.abs(F.col("lat") - F.col("sy")) / source.res
    return (
        spread.withColumns({"wx": wx, "wy": wy})
        .where((F.col("wx") > 1e-9) & (F.col("wy") > 1e-9))
        # Centres outside the source grid get no value.
        .where(
            source.row(F.col("lat")).between(0, source.rows - 1)
            & source.col(F.col("lon")).between(0, source.cols - 1)
        )
        # By tile first: the rows are already together.
        .groupBy("index", "year", "t_row", "t_col", "row", "col")
        .agg(
            F.sum(F.col("value") * F.col("wx") * F.col("wy")).alias("vw"),
            F.sum(F.col("wx") * F.col("wy")).alias("w"),
        )
        .select(
            "index", "year", "row", "col",
            target.lon(F.col("col")).alias("lon"), target.lat(F.col("row")).alias("lat"),
            (F.col("vw") / F.col("w")).alias("value"),
        )
    )


def class_of(value: Column, breaks) -> Column:
    """Class number of ``(a, b]`` intervals, the lowest one closed below; missing outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(breaks) - 1)):
        low = value >= breaks[i] if i == 0 else value > breaks[i]
        out = F.when(low & (value <= breaks[i + 1]), i).otherwise(out)
    return out


def classify(cells: DataFrame, breaks) -> DataFrame:
    return cells.withColumn("class", class_of(F.col("value"), breaks))


def class_label(class_no: Column, names=ANOMALY_CLASSES) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(names):
        out = F.when(class_no == i, name).otherwise(out)
    return out


def frequency(cells: DataFrame, column: str = "value") -> DataFrame:
    """How often each value occurs, missing ones left out."""
    return (
        cells.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_at(cells: DataFrame, points: DataFrame, grid: CellGrid) -> DataFrame:
    """Values of all layers at points (``lon, lat``), by cell position."""
    at = points.withColumns(
        {"row": grid.row(F.col("lat")), "col": grid.col(F.col("lon"))}
    ).where(grid.holds())
    layers = cells.select("index", "year", "row", "col", "value")
    return at.join(layers, ["row", "col"], "left")


def elevation_at(sites: DataFrame, dem: DataFrame, grid: CellGrid) -> DataFrame:
    """Elevation of sites from an elevation grid (``row, col, elevation``)."""
    at = sites.select("site_id", "lon", "lat").distinct().withColumns(
        {"row": grid.row(F.col("lat")), "col": grid.col(F.col("lon"))}
    )
    return at.join(dem, ["row", "col"], "left").select("site_id", "elevation")


def compare_grid(county: DataFrame, cells: DataFrame, cov: DataFrame) -> DataFrame:
    """County anomaly next to the zonal mean of the gridded anomaly product."""
    grid_mean = zonal(cells, cov).select(
        "poly_id", "index", "year", F.col("mean").alias("grid_anom")
    )
    return county.join(grid_mean, ["poly_id", "index", "year"], "left").withColumn(
        "difference", F.col("anom") - F.col("grid_anom")
    )
