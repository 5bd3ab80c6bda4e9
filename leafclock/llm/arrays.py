"""Arrays that tasks write to the shared folder and other tasks map into memory.

A file holds one array, raw. A task writes to a name of its own and renames, so a task that
runs twice, or dies half-way, leaves nothing wrong. Where the shared folder is mounted the
file is mapped in place and costs no memory of its own; from other stores a worker fetches
it to an unnamed temporary file first.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
import zstandard


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^(file:)?/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def save(path: str, data: np.ndarray) -> None:
    fs, name = _open(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B") if data.size else b"")
    fs.move(own, name)


def load(path: str, dtype) -> np.ndarray:
    fs, name = _open(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if fs.get_file_info(name).size else np.zeros(0, dtype)
    own = tempfile.TemporaryFile()
    with fs.open_input_stream(name) as source:
        while block := source.read(1 << 22):
            own.write(block)
    own.flush()
    return np.memmap(own, dtype, "r") if own.tell() else np.zeros(0, dtype)


def pack(data: np.ndarray, rising: bool = False) -> bytes:
    """Compressed bytes of unsigned numbers; ``rising`` numbers are stored as differences."""
    if rising:
        data = np.diff(data, prepend=data.dtype.type(0))
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), data.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    data = np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(data, dtype=dtype) if rising else data


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted values would stand among the sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


def by_part(parts: np.ndarray):
    """(part, positions) for each value of ``parts``."""
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order])) + 1
    for positions in np.split(order, edges):
        if len(positions):
            yield int(parts[positions[0]]), positions
