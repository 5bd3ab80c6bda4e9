"""Pools of prior records around each current record.

The pool of a current record holds the prior records of the same species and
phase at sites within a radius, in an open elevation band. Its size, years and
distribution depend only on the record's location, elevation, species and phase,
so they are computed once per such key and joined back.

``pool_sizes`` never lists the pairs. Prior records shrink to counts per location, elevation
and day, and locations fall in small tiles. If every point of one tile is inside the radius of
every point of another, the whole tile counts at once, for all keys of the first; only
tiles on the rim of the radius are compared location by location. The elevation band is
a moving window: per tile and block of elevation, each count enters and leaves the keys in
order of elevation once (``functions/bands.py``), so the work follows the counts and the keys, not their pairs.

The tables written here compress well, so the size of their files says little about their size
in memory: a hint keeps Spark from broadcasting them.

``neighbour_pool`` lists the records of each pool, for the few rows that need it; ``pool_index`` keeps
pools as whole tiles and places of the rim, to list a pool's records when they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafclock.functions import bands, stats
from leafclock.functions.geodesy import RadiusGrid, haversine, km_of, prepared
from leafclock.operators.clean import prior_of
from leafclock.params import Params
from leafclock.sources.scratch import staged

TILE = ["t_row", "t_col"]
PLACE = ["lat", "lon", "elev"]


def _grid(p: Params) -> RadiusGrid:
    return RadiusGrid(p.radius_km, p.tiles_per_radius)


def _with_tile(df: DataFrame, p: Params) -> DataFrame:
    """Tile of each row, and what distances and tile bounds need per location."""
    g = _grid(p)
    beta, lam = prepared(F.col("lat"), F.col("lon"), p.distance)
    return df.withColumns(
        {"t_row": g.tile_row(F.col("lat")), "t_col": g.tile_col(F.col("lon")),
         "beta": beta, "lam": lam}
    )


def _as_other(df: DataFrame, columns) -> DataFrame:
    """Prefix the prior side's columns, to join it with the current side."""
    return df.withColumnsRenamed({c: f"u_{c}" for c in columns})


def _in_band(p: Params) -> Column:
    """Open at both ends; a missing elevation on either side fails."""
    elev, other = F.col("elev"), F.col("u_elev")
    return (other > elev - p.elev_buffer) & (other < elev + p.elev_buffer)


def _in_radius(df: DataFrame, p: Params) -> DataFrame:
    """Pairs of locations within the radius. The haversine settles nearly all pairs;
    the full formula decides only those close to the radius."""
    b1, b2 = F.col("beta"), F.col("u_beta")
    g = _grid(p)
    h = haversine(b1, F.col("lam"), b2, F.col("u_lam"))
    # Exploding a one-element array keeps the value a column of its own; as a plain
    # alias it would be copied into every place of the formula that uses it.
    near = df.where(h <= g.hav_maybe).withColumn("hav", F.explode(F.array(h)))
    hav = F.col("hav")
    exact = km_of(hav, b1, b2, p.distance) <= p.radius_km
    return near.where((hav <= g.hav_surely) | exact).drop("hav")


def _near_tiles(left: DataFrame, right: DataFrame, on, p: Params, also=None) -> DataFrame:
    """Rows of ``left`` (``t_row, t_col``) and ``right`` (``u_t_row, u_t_col``) equal
    in ``on`` whose tiles may hold points within the radius; ``all_in`` if all do.
    ``also`` is a cheaper condition to test first."""
    g = _grid(p)

    def with_cosines(df, row, prefix):
        low, high = g.tile_cosines(F.col(row))
        return df.withColumns({f"{prefix}low": low, f"{prefix}high": high})

    blocked = with_cosines(g.near_blocks(left), "t_row", "t_")
    right = with_cosines(right, "u_t_row", "u_").withColumns(
        {"b_row": g.block_row(F.col("u_t_row")), "b_col": g.block_col(F.col("u_t_col"))}
    )
    across = F.abs(F.col("u_t_col") - F.col("t_col"))
    rows = F.abs(F.col("u_t_row") - F.col("t_row"))
    cols = F.least(across, F.lit(g.tile_cols) - across)
    nearest = g.nearest(rows, cols, F.col("t_low") * F.col("u_low"))
    farthest = g.farthest(rows, cols, F.col("t_high") * F.col("u_high"))
    return (
        blocked.join(right.hint("merge"), [*on, "b_row", "b_col"])
        .where((F.lit(True) if also is None else also) & (nearest <= g.hav_maybe))
        .withColumn("all_in", farthest <= g.hav_surely)
        .drop("b_row", "b_col", "t_low", "t_high", "u_low", "u_high")
    )


def _pool_keys(cur: DataFrame, p: Params) -> DataFrame:
    """The distinct pool keys of the current rows, numbered.

    Pairs then carry one number instead of five columns. The table is written, so
    the numbers stay the same for every branch that reads it.
    """
    keys = cur.select(*p.group_keys, *PLACE).dropna().distinct()
    keys = _with_tile(keys, p).withColumn("pool", F.monotonically_increasing_id())
    return staged(keys, "pool-keys").hint("merge")


def _moved_sites(rows: DataFrame, p: Params, missing: bool = False) -> DataFrame | None:
    """Sites with several coordinates within a species and phase; none if there are none.
    With ``missing``, also those that lack them in some rows.

    Such sites are rare, so the (tiny) list is written and looked at before any join
    is planned for it.
    """
    several = F.lit(False)
    for c in ("lat", "lon"):
        several = several | F.coalesce(F.min(c) != F.max(c), F.lit(False))
        if missing:
            several = several | (F.count(c) < F.count(F.lit(1)))
    moved = (
        rows.groupBy(*p.group_keys, "site_id")
        .agg(several.alias("moved"))
        .where("moved")
        .drop("moved")
    )
    moved = staged(moved, "moved-sites")
    return None if moved.isEmpty() else moved


def _near_sites(keys: DataFrame, sites: DataFrame, p: Params) -> DataFrame:
    """Pool locations and the sites with any location within the radius."""
    on = p.group_keys
    sites = _with_tile(sites.select(*on, "site_id", "lat", "lon").dropna().distinct(), p)
    right = _as_other(sites, ["lat", "lon", "t_row", "t_col", "beta", "lam"])
    left = keys.select(*on, "lat", "lon", "t_row", "t_col", "beta", "lam").distinct()
    return (
        _in_radius(_near_tiles(left, right, on, p), p)
        .select(*on, "lat", "lon", "site_id")
        .distinct()
    )


def _near_areas(keys: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """Pairs of a key's tile and a prior tile of the same species and phase that may hold
    points within the radius; ``whole`` if all their points are. Bounded by the map."""
    tile = ["t_row", "t_col"]
    left = keys.select(*p.group_keys, *tile).distinct()
    right = _as_other(rows.select(*p.group_keys, *tile).dropna().distinct(), tile)
    near = _near_tiles(left, right, p.group_keys, p).withColumnRenamed("all_in", "whole")
    return staged(near, "near-tiles").hint("merge")


def _reach(
    keys: DataFrame, near: DataFrame, rows: DataFrame, moved: DataFrame | None, roll, payload,
    p: Params,
) -> DataFrame:
    """Payload rows that keys of a tile may count: (keys, tile, lat, lon, u_elev, payload).

    A prior tile that lies wholly within the radius sends its rows once to all keys of the
    tile (``lat`` and ``lon`` missing); those on the rim send them to each location
    they reach. A moved site brings all its rows, once, if any location is within the radius.
    The elevation is left to ``_in_groups``. ``roll(df, by)`` combines payload rows that agree in ``by``.
    """
    on, tile = p.group_keys, ["t_row", "t_col"]
    u_tile = [f"u_{c}" for c in tile]
    rows = rows.where("elev IS NOT NULL")
    still = rows if moved is None else rows.join(moved, [*on, "site_id"], "left_anti")
    columns = [*on, *tile, "lat", "lon", "u_elev", *payload]
    nowhere = F.lit(None).cast("double")

    by_tile = _as_other(roll(still, [*on, *tile, "elev"]), [*tile, "elev"])
    inside = near.where("whole").join(by_tile, [*on, *u_tile]).withColumns({"lat": nowhere, "lon": nowhere})
    spot = ["lat", "lon", "beta", "lam"]
    left = keys.select(*on, *tile, *spot).distinct()
    right = _as_other(still.select(*on, *tile, *spot).dropna().distinct(), [*tile, *spot])
    rim = left.join(near.where("NOT whole"), [*on, *tile]).join(right, [*on, *u_tile])
    rim = _in_radius(rim, p).select(*on, *tile, "lat", "lon", "u_lat", "u_lon")
    by_place = _as_other(roll(still, [*on, *PLACE]), PLACE)
    out = inside.select(*columns).unionByName(
        rim.join(by_place.hint("merge"), [*on, "u_lat", "u_lon"]).select(*columns))
    if moved is None:
        return out
    some = rows.join(moved, [*on, "site_id"], "left_semi")
    by_site = roll(some, [*on, "site_id", "elev"]).withColumnRenamed("elev", "u_elev")
    reached = left.select(*on, *tile, "lat", "lon").join(_near_sites(keys, some, p), [*on, "lat", "lon"])
    return out.unionByName(reached.join(by_site.hint("merge"), [*on, "site_id"]).select(*columns))


def _in_groups(
    keys: DataFrame, reach: DataFrame, of_group, results: list[T.StructField], p: Params, names=None
) -> DataFrame:
    """``of_group`` of the keys and the rows of each tile and block of elevation.

    A row goes to the blocks whose keys may hold it in their band: one or two. It returns the
    keys it was given (``names`` of them, else species, phase, place), with ``results``.
    """
    on, band = p.group_keys, p.elev_buffer

    def block(elev):
        # Places somewhat below the sea belong to the lowest block above it.
        return F.floor((elev + 2 * band) / (8 * band))

    # A little more than the band, for rounding.
    blocks = F.sequence(block(F.col("u_elev") - 1.001 * band), block(F.col("u_elev") + 1.001 * band))
    by = [*on, "t_row", "t_col", "block"]
    names = names or [*on, *PLACE]
    left = keys.select(
        *dict.fromkeys([*names, *on, *PLACE]), "t_row", "t_col", block(F.col("elev")).alias("block"))
    right = reach.withColumn("block", F.explode(blocks))
    schema = T.StructType([*[left.schema[c] for c in names], *results])
    given, returned = list(dict.fromkeys([*names, *PLACE])), schema.names

    def call(_, some: pa.Table, rows: pa.Table) -> pa.Table:
        return of_group(some.select(given), rows).select(returned)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(call, schema)


def _day_counts(prior: DataFrame, p: Params) -> DataFrame:
    """Prior records as counts per site, place and day."""
    by = [*p.group_keys, "site_id", *PLACE, "first_yes"]
    years = p.prior_years
    words = stats.year_bits(F.col("year"), years)
    counts = (
        prior.select(*by, *words)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), *stats.or_years(years))
    )
    return staged(_with_tile(counts, p), "day-counts").hint("merge")


def _counts_of(rows: DataFrame, moved: DataFrame | None, keys: DataFrame, near: DataFrame, p: Params) -> DataFrame:
    """Day counts within reach of the keys of a tile."""
    years = p.prior_years

    def roll(df, by):
        return df.groupBy(*by, "first_yes").agg(F.sum("n").alias("n"), *stats.or_years(years))

    return _reach(keys, near, rows, moved, roll, ["first_yes", "n", *stats.year_words(years)], p)


def _summarize(
    keys: DataFrame, near: DataFrame, counts: DataFrame, moved: DataFrame | None, p: Params
) -> DataFrame:
    """Size, years, minimum and quantiles per pool key with any prior record."""
    probs, years, band = {"qearly": p.lowerq, "q25": 0.25, "q75": 0.75}, len(p.prior_years), p.elev_buffer
    day = counts.schema["first_yes"].dataType
    results = [T.StructField("n_obs_r", T.LongType()), T.StructField("n_yrs_r", T.LongType()), T.StructField("min", day)]
    results += [T.StructField(c, T.DoubleType()) for c in probs]

    def of_group(keys: pa.Table, rows: pa.Table) -> pa.Table:
        return bands.summaries(keys, rows, band, probs, years, stats.WORD)

    return _in_groups(keys, _counts_of(counts, moved, keys, near, p), of_group, results, p)


def pool_days(cur: DataFrame, prior: DataFrame, p: Params, carry=()) -> DataFrame:
    """Per current row: prior records in its pool by day, (``carry`` of current, first_yes, n), at most 366 rows.

    No prior row is listed. Days are counted once per pool key and meet the current rows by its number;
    both sides follow the records, and the files of the current rows compress well, so none is broadcast.
    """
    prior, band = prior_of(prior, p), p.elev_buffer
    keys, counts = _pool_keys(cur, p), _day_counts(prior, p)
    near, moved = _near_areas(keys, counts, p), _moved_sites(counts, p)

    def of_group(keys: pa.Table, rows: pa.Table) -> pa.Table:
        return bands.days(keys, rows, band)

    results = [counts.schema["first_yes"], T.StructField("n", T.LongType())]
    days = _in_groups(keys, _counts_of(counts, moved, keys, near, p), of_group, results, p, ["pool"])
    key = [*p.group_keys, *PLACE]
    left = cur.select(*dict.fromkeys([*key, *carry])).join(keys.select("pool", *key), key)
    return left.select("pool", *carry).join(days.hint("merge"), "pool").drop("pool")


def _pool_individuals(
    keys: DataFrame, near: DataFrame, prior: DataFrame, moved: DataFrame | None, p: Params
) -> DataFrame:
    """Exact number of individuals per pool key, a missing one counted as one.

    A tile's rows are its individuals by elevation; each counts once in a band however
    many of its homes are there.
    """
    on, band = p.group_keys, p.elev_buffer
    homes = (
        prior.where(F.col("elev").isNotNull())
        .select(*on, F.col("site_id"), *PLACE, F.col(p.unit).alias("unit"))
        .distinct()
    )
    homes = staged(_with_tile(homes, p), "homes").hint("merge")

    def roll(df, by):
        return df.select(*dict.fromkeys([*by, "unit"])).distinct()

    def of_group(keys: pa.Table, rows: pa.Table) -> pa.Table:
        return bands.individuals(keys, rows, band)

    reach = _reach(keys, near, homes, moved, roll, ["unit"], p)
    return _in_groups(keys, reach, of_group, [T.StructField("n_indiv_r", T.LongType())], p)


def pool_sizes(cur: DataFrame, prior: DataFrame, p: Params, individuals: bool = True):
    """Current rows with their pool's sizes and distribution.

    Sizes are missing if the species and phase have no prior record at all, and 0
    if none of its records qualifies. The day counts feed several joins, so they
    are written once; pass current rows that are cheap to read again.
    """
    pool_key = [*p.group_keys, *PLACE]
    prior = prior_of(prior, p)
    keys, counts = _pool_keys(cur, p), _day_counts(prior, p)
    near, moved = _near_areas(keys, counts, p), _moved_sites(counts, p)
    known = counts.select(*p.group_keys).distinct().withColumn("known", F.lit(True))
    summary = _summarize(keys, near, counts, moved, p)
    sizes = ["n_obs_r", "n_yrs_r"]
    if individuals:
        summary = summary.join(_pool_individuals(keys, near, prior, moved, p), pool_key, "left")
        sizes.append("n_indiv_r")
    return (
        cur.join(summary, pool_key, "left")
        .join(known, p.group_keys, "left")
        .withColumns(
            {c: F.when(F.col("known"), F.coalesce(c, F.lit(0).cast("long"))) for c in sizes}
        )
        .drop("known")
    )


def neighbour_pool(cur: DataFrame, prior: DataFrame, p: Params, carry=()) -> DataFrame:
    """The prior rows in the pool of each current row: (``carry`` of current, prior row).

    Tiles and places are matched first; current rows then go to the tiles, places and blocks of
    elevation they reach, and meet each prior row there. The result is as large as the pools, so pass the
    flagged rows only; nothing of that size is moved between tasks.
    """
    on = p.group_keys
    names = [f"cur_{c}" for c in carry]
    left = _with_tile(cur.select(*on, *PLACE, *[F.col(c).alias(n) for c, n in zip(carry, names)]), p)
    paths = _paths(left, prior_of(prior, p), p, missing=True)
    return _rows_within(left, names, paths, prior, p)


@dataclass(frozen=True)
class Paths:
    """Where the pools of current locations lie, as pairs of tiles and places of a species and phase.

    ``cells`` (keys, t_row, t_col, u_t_row, u_t_col) are tiles wholly within reach of a tile, ``places`` (keys, lat, lon,
    u_lat, u_lon) the places of the rim within reach of a location, ``sites`` (keys, lat, lon, site_id) the moved
    sites within reach, which ``moved`` lists. All are written; their size follows the map and its sites, not
    the records, current or prior.
    """

    cells: DataFrame
    places: DataFrame
    sites: DataFrame | None
    moved: DataFrame | None


def _paths(left: DataFrame, prior: DataFrame, p: Params, missing: bool = False) -> Paths:
    on, spot = p.group_keys, ["lat", "lon", "beta", "lam"]
    u_tile = [f"u_{c}" for c in TILE]
    keys = staged(left.select(*on, *TILE, *spot).dropna().distinct(), "pool-spots").hint("merge")
    sites = staged(_with_tile(prior.select(*on, "site_id", "lat", "lon").distinct(), p), "pool-sites").hint("merge")
    moved = _moved_sites(sites, p, missing)
    still = sites if moved is None else sites.join(moved, [*on, "site_id"], "left_anti")
    near = _near_areas(keys, still, p)
    right = _as_other(still.select(*on, *TILE, *spot).dropna().distinct(), [*TILE, *spot])
    rim = keys.join(near.where("NOT whole"), [*on, *TILE]).join(right, [*on, *u_tile])
    rim = _in_radius(rim, p).select(*on, "lat", "lon", "u_lat", "u_lon")
    theirs = None
    if moved is not None:
        some = sites.join(moved, [*on, "site_id"], "left_semi")
        theirs = staged(_near_sites(keys, some, p), "pool-moved").hint("merge")
    return Paths(near.where("whole").select(*on, *TILE, *u_tile).hint("merge"), staged(rim, "pool-places").hint("merge"), theirs, moved)


def _rows_within(left: DataFrame, names, paths: Paths, prior: DataFrame, p: Params) -> DataFrame:
    """(``names`` of ``left``, prior row) for all prior rows in the pools of ``left`` (keys, place, tile, names).

    ``left`` goes to each tile or place it reaches and the three or four blocks of elevation of its band; prior rows go to
    one of each, so what is moved follows both sides and the map, and pairs arise where they are written.
    """
    on, band = p.group_keys, p.elev_buffer
    prior = prior_of(prior, p)
    # A little more than the band, for rounding.
    low, high = (F.floor((F.col("elev") + side * 1.001 * band) / band) for side in (-1, 1))
    left = left.select(*on, *PLACE, *TILE, *names).where(F.col("elev").isNotNull())
    rows = _with_tile(prior, p).drop("beta", "lam").where("elev IS NOT NULL AND site_id IS NOT NULL")
    rows = _as_other(rows.withColumn("block", F.floor(F.col("elev") / band)), [*PLACE, *TILE])
    columns = [*names, *[F.col(f"u_{c}").alias(c) if c in PLACE else F.col(c) for c in prior.columns]]
    still = rows if paths.moved is None else rows.join(paths.moved, [*on, "site_id"], "left_anti")

    def met(asking: DataFrame, rows: DataFrame, by) -> DataFrame:
        asking = asking.withColumn("block", F.explode(F.sequence(low, high)))
        # Prior rows stream past the (fewer) current rows of a cell: pairs that follow each other differ in the current row only.
        return rows.hint("merge").join(asking, [*on, *by, "block"]).where(_in_band(p)).select(*columns)

    out = met(left.join(paths.cells, [*on, *TILE]), still, [f"u_{c}" for c in TILE])
    out = out.unionByName(met(left.join(paths.places, [*on, "lat", "lon"]), still, ["u_lat", "u_lon"]))
    if paths.moved is None:
        return out
    some = rows.join(paths.moved, [*on, "site_id"], "left_semi")
    return out.unionByName(met(left.join(paths.sites, [*on, "lat", "lon"]), some, ["site_id"]))


@dataclass(frozen=True)
class PoolIndex(Paths):
    """Stored pools: ``keys`` (pool, keys, place, tile) and the paths from their locations to prior tiles and places."""

    keys: DataFrame


def pool_index(cur: DataFrame, prior: DataFrame, p: Params) -> PoolIndex:
    """The pools of the current rows' keys, encoded by tiles and places."""
    keys = _pool_keys(cur, p)
    paths = _paths(keys, prior_of(prior, p), p)
    return PoolIndex(paths.cells, paths.places, paths.sites, paths.moved, keys)


def pool_rows(
    index: PoolIndex, prior: DataFrame, p: Params, of: DataFrame | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """The prior rows of each pool: (pool, prior row); with ``of``, only of the pools of its rows.

    ``carry`` (keys, place and further columns) gives rows instead of pools: (further columns, prior row) for each of
    its rows. No distance is computed again.
    """
    key = [*p.group_keys, *PLACE]
    left, names = index.keys.select("pool", *key, *TILE), ["pool"]
    if of is not None:
        wanted = staged(of.select(*key).distinct(), "wanted")
        left = staged(left.join(wanted, key, "left_semi"), "wanted-pools")
    if carry is not None:
        names = [c for c in carry.columns if c not in key]
        left = left.join(carry, key).drop("pool")
    return _rows_within(left, names, index, prior, p)


def restrict_to_current(prior: DataFrame, cur: DataFrame, keys) -> DataFrame:
    """Prior rows whose key occurs in the current year.

    The key list is written first: Spark then knows its size when it plans the join,
    and a short list is broadcast without shuffling the prior rows.
    """
    wanted = staged(cur.select(*keys).distinct(), "keys")
    return prior.join(wanted, list(keys), "left_semi")


def missing_keys(cur: DataFrame, cached: DataFrame, keys) -> DataFrame:
    """Keys seen in the current year and absent from the cache."""
    return cur.select(*keys).distinct().join(
        cached.select(*keys).distinct(), list(keys), "left_anti"
    )
