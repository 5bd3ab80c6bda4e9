"""Counts of rows in an open band of elevation around each key, for one group of keys and rows.

Keys (``lat, lon, elev``) and rows (``lat, lon, u_elev`` and what they count) are Arrow tables of one
tile and block of elevation. Rows without a location count for all keys, the others for the keys
at theirs. In order of elevation, the keys that hold a row in their band are one run, so a
row is added where its run begins and taken off where it ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Keys whose days are held at once.
CHUNK = 1024


def _floats(table: pa.Table, name: str) -> np.ndarray:
    """Missing values are NaN; minus zero is zero, as in a join."""
    return table[name].cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, a missing one included, and the values in ascending order, a missing one first."""
    values = pc.unique(column)
    values = values.take(pc.sort_indices(values, null_placement="at_start"))
    return pc.index_in(column, values).to_numpy(zero_copy_only=False).astype(np.int64), values


def _places(table: pa.Table) -> list[tuple[float, float]]:
    return list(zip(_floats(table, "lat").tolist(), _floats(table, "lon").tolist()))


def _runs(elev: np.ndarray, at: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the run of keys (``elev`` ascending) that hold each row in their open band."""
    begin = np.searchsorted(elev + band, at, side="right")
    return begin, np.maximum(begin, np.searchsorted(elev - band, at, side="left"))


def _added(begin, end, weight, n_keys: int, column=None, n_columns: int = 1) -> np.ndarray:
    """Sum of the weights per key, and column if given."""
    column = 0 if column is None else column
    size = (n_keys + 1) * n_columns
    steps = np.bincount(begin * n_columns + column, weight, size) - np.bincount(end * n_columns + column, weight, size)
    return np.rint(np.cumsum(steps.reshape(n_keys + 1, n_columns), axis=0)[:n_keys]).astype(np.int64)


def _chunks(keys: pa.Table, rows: pa.Table):
    """Runs of keys in order of elevation: (their indices, elevations, parts), where each part is
    (which of these keys, which rows); the first one, all keys and the rows without a location."""
    elev = _floats(keys, "elev")
    order = np.argsort(elev, kind="stable")
    places, whole = _places(keys), np.isnan(_floats(rows, "lat"))
    own: dict[tuple[float, float], list[int]] = {}
    for i, place in zip(np.flatnonzero(~whole).tolist(), _places(rows.filter(pa.array(~whole)))):
        own.setdefault(place, []).append(i)
    for start in range(0, len(order), CHUNK):
        index = order[start : start + CHUNK]
        at: dict[tuple[float, float], list[int]] = {}
        for i, k in enumerate(index.tolist()):
            at.setdefault(places[k], []).append(i)
        parts = [(np.arange(len(index)), np.flatnonzero(whole))]
        parts += [(np.array(some), np.array(own[place])) for place, some in at.items() if place in own]
        yield index, elev[index], parts


def _histograms(keys: pa.Table, rows: pa.Table, band: float, of_day: np.ndarray, n_days: int, seen=None):
    """Per chunk: indices of keys, counts per key and day, and per key the rows that have each mark of ``seen``."""
    at, n = _floats(rows, "u_elev"), rows["n"].to_numpy().astype(np.float64)
    seen = np.zeros((len(at), 0), bool) if seen is None else seen
    columns = n_days + seen.shape[1]
    for index, elev, parts in _chunks(keys, rows):
        counts = np.zeros((len(index), columns), np.int64)
        for some, which in parts:
            begin, end = _runs(elev[some], at[which], band)
            row, mark = np.nonzero(seen[which])
            row = np.concatenate([np.arange(len(which)), row])
            column, weight = np.concatenate([of_day[which], n_days + mark]), np.concatenate([n[which], np.ones(len(mark))])
            counts[some] += _added(begin[row], end[row], weight, len(some), column, columns)
        yield index, counts[:, :n_days], counts[:, n_days:]


def summaries(keys: pa.Table, rows: pa.Table, band: float, probs: dict, years: int, word: int) -> pa.Table:
    """Keys with any row: their number of records and years, the first day and type 7 quantiles of the days."""
    of_day, days = _codes(rows["first_yes"])
    missing = int(days.null_count > 0)
    values = days.cast(pa.float64()).to_numpy(zero_copy_only=False)
    words = [rows[f"years_{i}"].to_numpy() for i in range(-(-max(1, years) // word))]
    seen = np.stack([(words[y // word] >> np.int64(y % word)) & 1 > 0 for y in range(years)], axis=1)
    found = []
    for index, counts, sums in _histograms(keys, rows, band, of_day, len(days), seen):
        total = counts.sum(axis=1)
        some = np.flatnonzero(total > 0)
        counts, total = counts[some], total[some]
        upto = np.cumsum(counts, axis=1)
        # Missing days come first in rank, and are passed over when a value is picked.
        known = counts[:, missing:] > 0
        last = len(days)

        def pick(rank):
            reached = known & (upto[:, missing:] > rank[:, None])
            return np.where(reached.any(axis=1), reached.argmax(axis=1) + missing if last > missing else 0, last)

        padded = np.append(values, np.nan)
        out = {"n_obs_r": total, "n_yrs_r": (sums[some] > 0).sum(axis=1), "min": padded[pick(np.full(len(some), -1))]}
        for name, prob in probs.items():
            at = (total - 1) * float(prob)
            low = padded[pick(np.floor(at).astype(np.int64))]
            high = padded[pick(np.floor(at).astype(np.int64) + 1)]
            out[name] = low + (at - np.floor(at)) * (np.where(np.isnan(high), low, high) - low)
        table = keys.take(pa.array(index[some]))
        for name, column in out.items():
            column = pa.array(column, from_pandas=True)
            table = table.append_column(name, column.cast(rows["first_yes"].type) if name == "min" else column)
        found.append(table)
    return pa.concat_tables(found) if found else _none(keys, {
        "n_obs_r": pa.int64(), "n_yrs_r": pa.int64(), "min": rows["first_yes"].type, **dict.fromkeys(probs, pa.float64())})


def days(keys: pa.Table, rows: pa.Table, band: float) -> pa.Table:
    """Number of records per key and day, where there are any."""
    of_day, values = _codes(rows["first_yes"])
    found = []
    for index, counts, _ in _histograms(keys, rows, band, of_day, len(values)):
        key, day = np.nonzero(counts)
        found.append(
            keys.take(pa.array(index[key])).append_column("first_yes", values.take(pa.array(day)))
            .append_column("n", pa.array(counts[key, day])))
    return pa.concat_tables(found) if found else _none(keys, {"first_yes": rows["first_yes"].type, "n": pa.int64()})


def _distinct(elev: np.ndarray, at: np.ndarray, unit: np.ndarray, band: float) -> np.ndarray:
    """Different units per key (``elev`` ascending).

    The runs of one unit have the same band, so those that hold a key follow each other: add
    each run, and take off what it shares with the unit's next one.
    """
    order = np.lexsort((at, unit))
    begin, end = _runs(elev, at[order], band)
    unit = unit[order]
    n = _added(begin, end, np.ones(len(unit)), len(elev))[:, 0]
    same = unit[1:] == unit[:-1]
    first, last = begin[1:][same], end[:-1][same]
    return n - _added(first, np.maximum(first, last), np.ones(len(first)), len(elev))[:, 0]


def individuals(keys: pa.Table, rows: pa.Table, band: float) -> pa.Table:
    """Number of different units per key with any row."""
    unit, at = _codes(rows["unit"])[0], _floats(rows, "u_elev")
    found = []
    for index, elev, parts in _chunks(keys, rows):
        whole = parts[0][1]
        n = _distinct(elev, at[whole], unit[whole], band)
        for some, which in parts[1:]:
            # What the location's own rows add to the units that count for the whole tile.
            also = whole[np.isin(unit[whole], unit[which])]
            both = np.concatenate([also, which])
            n[some] += _distinct(elev[some], at[both], unit[both], band) - _distinct(elev[some], at[also], unit[also], band)
        some = np.flatnonzero(n > 0)
        found.append(keys.take(pa.array(index[some])).append_column("n_indiv_r", pa.array(n[some])))
    return pa.concat_tables(found) if found else _none(keys, {"n_indiv_r": pa.int64()})


def _none(keys: pa.Table, results: dict) -> pa.Table:
    table = keys.slice(0, 0)
    for name, kind in results.items():
        table = table.append_column(name, pa.array([], kind))
    return table
