"""Distances on the earth and the grid used to find neighbours, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and mean earth radius, km.
WGS84_A = 6378.137
WGS84_F = 1 / 298.257223563
MEAN_RADIUS = 6371.0088
# A sphere differs from the ellipsoid by at most 0.56 %; bounds use 1 %.
MARGIN = 0.01


# Expressions are kept short on purpose: the JVM does not compile a generated
# method above 8,000 bytecodes, and a join condition with long trigonometry passes that.


def _sq(column: Column) -> Column:
    return F.pow(column, F.lit(2.0))


def _hav(angle: Column) -> Column:
    return _sq(F.sin(angle / 2))


def prepared(lat: Column, lon: Column, method: str = "ellipsoid") -> tuple[Column, Column]:
    """What a distance needs of one location: latitude (reduced, on the ellipsoid)
    and longitude in radians. Computed once per location, not once per pair."""
    if method not in ("ellipsoid", "sphere"):
        raise ValueError(f"unknown distance method {method!r}")
    phi = F.radians(lat)
    if method == "ellipsoid":
        phi = F.atan((1 - WGS84_F) * F.tan(phi))
    return phi, F.radians(lon)


def haversine(b1: Column, l1: Column, b2: Column, l2: Column) -> Column:
    """Haversine of the central angle between prepared locations."""
    return _hav(b2 - b1) + F.cos(b1) * F.cos(b2) * _hav(l2 - l1)


def km_of(h: Column, b1: Column, b2: Column, method: str = "ellipsoid") -> Column:
    """Distance from the haversine ``h``; on the ellipsoid by Lambert's long-line
    formula (metres of error at these ranges)."""
    h = F.least(F.lit(1.0), h)
    s = 2 * F.asin(F.sqrt(h))
    if method == "sphere":
        return MEAN_RADIUS * s
    sin_s = 2 * F.sqrt(h * (1 - h))
    p, q = _hav(b1 + b2), _hav(b2 - b1)
    # The formula does not hold for opposite points; only avoid dividing by zero.
    x = (s - sin_s) * p * (1 - q) / F.greatest(1 - h, F.lit(1e-12))
    y = (s + sin_s) * (1 - p) * q / h
    return F.when(h == 0, F.lit(0.0)).otherwise(WGS84_A * (s - WGS84_F / 2 * (x + y)))


def distance_km(lat1, lon1, lat2, lon2, method: str = "ellipsoid") -> Column:
    (b1, l1), (b2, l2) = prepared(lat1, lon1, method), prepared(lat2, lon2, method)
    return km_of(haversine(b1, l1, b2, l2), b1, b2, method)


def hav_of_km(km: float) -> float:
    """Haversine of a distance on the sphere."""
    return math.sin(min(math.pi, km / MEAN_RADIUS) / 2) ** 2


@dataclass(frozen=True)
class RadiusGrid:
    """Two nested grids for a fixed radius.

    Blocks are at least one radius high, so everything within the radius of a
    block lies in the neighbouring blocks; tiles divide a block and are small
    enough that most tile pairs are wholly inside or wholly outside the radius.
    """

    radius_km: float
    tiles: int = 8

    @property
    def reach_deg(self) -> float:
        return min(180.0, math.degrees(self.radius_km * (1 + MARGIN) / MEAN_RADIUS))

    @property
    def block_rows(self) -> int:
        return max(1, int(180.0 / self.reach_deg))

    @property
    def block_cols(self) -> int:
        # Wider than high: one neighbour each side suffices up to about 50 degrees.
        return max(1, int(360.0 / (1.6 * self.reach_deg)))

    @property
    def tile_rows(self) -> int:
        return self.block_rows * self.tiles

    @property
    def tiles_across(self) -> int:
        return max(1, round(self.tiles * 1.6))

    @property
    def tile_cols(self) -> int:
        return self.block_cols * self.tiles_across

    def tile_row(self, lat: Column) -> Column:
        raw = F.floor((lat + 90.0) * (self.tile_rows / 180.0)).cast("int")
        return F.least(raw, F.lit(self.tile_rows - 1))

    def tile_col(self, lon: Column) -> Column:
        raw = F.floor((lon + 180.0) * (self.tile_cols / 360.0)).cast("int")
        return F.pmod(raw, F.lit(self.tile_cols))

    def block_row(self, tile_row: Column) -> Column:
        return F.floor(tile_row / self.tiles).cast("int")

    def block_col(self, tile_col: Column) -> Column:
        return F.floor(tile_col / self.tiles_across).cast("int")

    def near_blocks(self, df: DataFrame) -> DataFrame:
        """Explode rows with ``t_row, t_col`` to every block within reach
        (``b_row, b_col``); longitudes wrap, and near the poles all columns match."""
        high = 180.0 / self.block_rows
        row, col = self.block_row(F.col("t_row")), self.block_col(F.col("t_col"))
        top = F.greatest(F.abs(row * high - 90.0), F.abs((row + 1) * high - 90.0))
        spread = F.degrees(
            F.asin(
                F.least(
                    F.lit(1.0),
                    F.lit(math.sin(math.radians(min(90.0, self.reach_deg))))
                    / F.cos(F.radians(F.least(top, F.lit(89.9)))),
                )
            )
        )
        half = self.block_cols // 2
        k = F.when(top + self.reach_deg >= 89.9, F.lit(half)).otherwise(
            F.least(F.lit(half), F.floor(spread * (self.block_cols / 360.0)).cast("int") + 1)
        )
        # The upper end stops short of meeting the lower end around the globe.
        steps = F.sequence(-k, F.least(k, F.lit(self.block_cols - 1) - k))
        rows = F.sequence(
            F.greatest(F.lit(0), row - 1), F.least(F.lit(self.block_rows - 1), row + 1)
        )
        return (
            df.withColumn("b_row", F.explode(rows))
            .withColumn("b_step", F.explode(steps))
            .withColumn("b_col", F.pmod(col + F.col("b_step"), F.lit(self.block_cols)))
            .drop("b_step")
        )

    def tile_cosines(self, row: Column) -> tuple[Column, Column]:
        """Smallest and largest cosine of latitude within a tile."""
        high = 180.0 / self.tile_rows
        south, north = F.cos(F.radians(row * high - 90.0)), F.cos(F.radians((row + 1) * high - 90.0))
        over_equator = (row * high < 90.0) & ((row + 1) * high > 90.0)
        largest = F.when(over_equator, F.lit(1.0)).otherwise(F.greatest(south, north))
        return F.greatest(F.lit(0.0), F.least(south, north)), largest

    def nearest(self, rows: Column, cols: Column, cosines: Column) -> Column:
        """Lower bound of the haversine between points of tiles that many rows and
        columns apart; ``cosines`` is the product of the smallest cosines."""
        return self._hav_apart(F.greatest(rows - 1, F.lit(0)), F.greatest(cols - 1, F.lit(0)), cosines)

    def farthest(self, rows: Column, cols: Column, cosines: Column) -> Column:
        """Upper bound likewise; ``cosines`` is the product of the largest cosines."""
        half = F.lit(self.tile_cols / 2.0)
        return self._hav_apart(rows + 1, F.least(cols + 1, half), cosines)

    def _hav_apart(self, rows: Column, cols: Column, cosines: Column) -> Column:
        high, wide = math.pi / self.tile_rows, 2 * math.pi / self.tile_cols
        return _hav(rows * high) + cosines * _hav(cols * wide)

    @property
    def hav_maybe(self) -> float:
        """Above this lower bound no point is within the radius."""
        return hav_of_km(self.radius_km / (1 - MARGIN))

    @property
    def hav_surely(self) -> float:
        """Up to this upper bound every point is within the radius."""
        return hav_of_km(self.radius_km / (1 + MARGIN))
