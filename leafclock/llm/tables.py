"""Tables of 64-bit keys and numbers: sorted arrays in the shared folder, mapped by workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafclock.llm.arrays import by_part, find, load, save
from leafclock.llm.common import over_batches
from leafclock.llm.ngram_lm import top
from leafclock.sources.scratch import scratch_dir


def part_bits(rows: int) -> int:
    """For parts of about a quarter of a million rows."""
    return max(0, (rows >> 18).bit_length())


@dataclass(frozen=True)
class Table:
    """Saved sorted hash arrays: keys and values in 2 ** bits parts."""

    folder: str
    bits: int
    sizes: tuple[int, ...]
    kind: str = "float32"


class Reader:
    """Maps a table."""

    def __init__(self, t: Table):
        self.bits = t.bits
        self.parts = [
            (load(f"{t.folder}/key-{p}", np.uint64), load(f"{t.folder}/value-{p}", np.dtype(t.kind))) if n else None
            for p, n in enumerate(t.sizes)]

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        for p, i in by_part(top(keys, self.bits)):
            if self.parts[p] is not None:
                held, values = self.parts[p]
                at, known = find(held, keys[i])
                out[i[known]] = values[at[known]]
        return out


_readers: dict[str, Reader] = {}


def reader(t: Table) -> Reader:
    """A few tables stay open in a worker."""
    if t.folder not in _readers:
        if len(_readers) > 3:
            _readers.clear()
        _readers[t.folder] = Reader(t)
    return _readers[t.folder]


def saved(rows: DataFrame, keyed, bits: int, gather: int = 200_000, kind: str = "float32") -> Table:
    """Saves (key, value) that ``keyed`` makes of every batch of rows."""
    folder = scratch_dir(rows.sparkSession, "table")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, values = keyed(batch)
        return pa.RecordBatch.from_arrays([
            pa.array(top(keys, bits).astype(np.int32)), pa.array(keys.view(np.int64)),
            pa.array(values.astype(kind))], ["part", "key", "value"])

    def store(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, values = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy()
        order, part = np.argsort(keys), key[0].as_py()
        save(f"{folder}/key-{part}", keys[order])
        save(f"{folder}/value-{part}", values[order])
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)]})

    got = over_batches(rows, run, f"part int, key long, value {'float' if kind == 'float32' else 'double'}", gather=gather).groupBy("part").applyInArrow(store, "part int, n long").collect()
    sizes = [0] * (1 << bits)
    for r in got:
        sizes[r.part] = r.n
    return Table(folder, bits, tuple(sizes), kind)
