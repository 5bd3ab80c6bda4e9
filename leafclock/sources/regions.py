"""Region polygons with their attribute tables: a data source of shapefiles.

    regions = read_regions(spark, "…/us_states.shp")       # or a folder of such files
    edges = polygon_edges(region_vertices(regions, "postal"))

A file is three: ``.shp`` holds the records, ``.shx`` where each begins, ``.dbf`` a row of fixed
width for each. Both kinds of offset are known beforehand, so a partition is a run of record numbers
of one file, and its task reads only their bytes; it holds one batch of records, never a file.

A row is a record: ``file``, ``record`` (its place in the file), the attributes, and ``rings``, an array of
outlines, each an array of (x, y) without the closing vertex. A null shape has null ``rings``. Attributes named
like one of the three columns get an underscore behind. A blank attribute is null, so an empty text comes
back as null; a number that does not parse is null. Rows marked as deleted are left out. Texts are in
the encoding of the ``.cpg`` file, else in that of the option ``encoding`` (UTF-8). Heights and
measures (polygons Z and M) are left out; shapes other than polygons fail.

Written files count once the job commits: tasks write names with a dot in front, which no
reader lists, and the commit renames them. A task begins a new file after ``file_bytes``.
"""

from __future__ import annotations

import datetime
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from leafclock.sources.grids import polygon_edges

# Fixed values of the file format.
FILE_CODE, VERSION, HEADER, INDEX_ENTRY = 9994, 1000, 100, 8
NULL_SHAPE, POLYGON, POLYGON_Z, POLYGON_M = 0, 5, 15, 25
TEXT_WIDTH, NUMBER_WIDTH, NAME_BYTES = 254, 24, 10

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_OWN = ("file", "record", "rings")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^(file:)?/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Field:
    """A column of an attribute table."""

    name: str
    kind: str
    start: int
    width: int
    decimals: int

    @property
    def column(self) -> str:
        return self.name + "_" if self.name.lower() in _OWN else self.name

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.width <= 18 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, row: bytes, encoding: str, type_: T.DataType):
        raw = row[self.start:self.start + self.width].strip(b" \0")
        if not raw:
            return None
        if self.kind == "L":
            return {b"t": True, b"y": True, b"f": False, b"n": False}.get(raw.lower())
        try:
            if self.kind == "D":
                return datetime.datetime.strptime(raw.decode("ascii"), "%Y%m%d").date()
            if self.kind in "NF":
                return int(raw) if isinstance(type_, T.LongType) else float(raw)
        except ValueError:
            return None
        return raw.decode(encoding, "replace")


class Files:
    """The three files of one table of regions."""

    def __init__(self, path: str, encoding: str):
        self.fs, name = _open(path)
        self.stem, self.encoding = name[:-4], encoding
        cpg = f"{self.stem}.cpg"
        if self._there(cpg):
            with self.fs.open_input_stream(cpg) as f:
                self.encoding = f.read().decode("ascii").strip() or encoding

    def _there(self, name: str) -> bool:
        return self.fs.get_file_info(name).type == pafs.FileType.File

    def count(self) -> int:
        return (self.fs.get_file_info(f"{self.stem}.shx").size - HEADER) // INDEX_ENTRY

    def fields(self) -> tuple[int, int, list[Field]]:
        """Bytes of the attribute table's header and of one row, and the columns."""
        if not self._there(f"{self.stem}.dbf"):
            return 0, 0, []
        with self.fs.open_input_file(f"{self.stem}.dbf") as f:
            header, width = struct.unpack("<HH", f.read_at(4, 8))
            raw = f.read_at(header - 32, 32)
        fields, start = [], 1
        for at in range(0, len(raw) - 31, 32):
            if raw[at] == 0x0D:
                break
            name = raw[at:at + 11].split(b"\0")[0].decode("ascii", "replace").strip()
            fields.append(Field(name, chr(raw[at + 11]), start, raw[at + 16], raw[at + 17]))
            start += raw[at + 16]
        return header, width, fields

    def attributes(self, start: int, stop: int) -> Iterator[bytes]:
        header, width, fields = self.fields()
        if not fields:
            yield from (b" " for _ in range(start, stop))
            return
        with self.fs.open_input_file(f"{self.stem}.dbf") as f:
            for k in range(start, stop):
                yield f.read_at(width, header + k * width)

    def shapes(self, start: int, stop: int) -> Iterator[list[np.ndarray] | None]:
        with self.fs.open_input_file(f"{self.stem}.shx") as f:
            index = np.frombuffer(f.read_at(INDEX_ENTRY * (stop - start), HEADER + INDEX_ENTRY * start), ">i4").reshape(-1, 2)
        with self.fs.open_input_file(f"{self.stem}.shp") as f:
            for at, length in index.astype(np.int64) * 2:
                yield outlines(f.read_at(int(length), int(at) + 8), f"{self.stem}.shp")


def outlines(content: bytes, name: str = "") -> list[np.ndarray] | None:
    """The rings of a record, each (n, 2) without the closing vertex; None for a null shape."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == NULL_SHAPE:
        return None
    if kind not in (POLYGON, POLYGON_Z, POLYGON_M):
        raise ValueError(f"{name}: shapes of type {kind} are not polygons")
    n_rings, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_rings, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_rings).reshape(-1, 2)
    rings = np.split(points, starts[1:]) if n_rings else []
    return [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]


def _nested(shapes: list[list[np.ndarray] | None]) -> pa.Array:
    """Arrow lists of lists of points."""
    rings = [r for shape in shapes for r in shape or ()]
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    ends = np.cumsum([0, *(len(r) for r in rings)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), flat)
    outer = np.cumsum([0, *(len(s or ()) for s in shapes)]).astype(np.int32)
    missing = np.array([s is None for s in shapes] + [False])
    return pa.ListArray.from_arrays(pa.array(outer, mask=missing), lists)


@dataclass
class Records(InputPartition):
    file: str
    start: int
    stop: int


class RegionReader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, encoding: str, records: int, batch_bytes: int):
        self.files, self.schema, self.encoding = files, schema, encoding
        self.records, self.batch_bytes = records, batch_bytes

    def partitions(self) -> list[Records]:
        runs = []
        for file in self.files:
            n = Files(file, self.encoding).count()
            runs += [Records(file, k, min(k + self.records, n)) for k in range(0, n, self.records)]
        return runs or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files = Files(partition.file, self.encoding)
        fields = {f.column.lower(): f for f in files.fields()[2]}
        held, size = [], 0
        rows = zip(files.attributes(partition.start, partition.stop), files.shapes(partition.start, partition.stop))
        for number, (row, shape) in enumerate(rows, partition.start):
            if row[:1] == b"*":
                continue
            held.append((number, row, shape))
            size += len(row) + sum(r.nbytes for r in shape or ())
            if size >= self.batch_bytes:
                yield self._batch(partition.file, held, fields, files.encoding)
                held, size = [], 0
        if held:
            yield self._batch(partition.file, held, fields, files.encoding)

    def _batch(self, file: str, held: list, fields: dict[str, Field], encoding: str) -> pa.RecordBatch:
        columns = []
        for c in self.schema.fields:
            name = c.name.lower()
            if name == "file":
                columns.append(pa.array([file.rsplit("/", 1)[-1]] * len(held), pa.string()))
            elif name == "record":
                columns.append(pa.array([number for number, _, _ in held], pa.int64()))
            elif name == "rings":
                columns.append(_nested([shape for _, _, shape in held]))
            elif name in fields:
                values = [fields[name].value(row, encoding, c.dataType) for _, row, _ in held]
                columns.append(pa.array(values, _ARROW[type(c.dataType)]))
            else:  # a column that this file lacks
                columns.append(pa.nulls(len(held), _ARROW[type(c.dataType)]))
        return pa.RecordBatch.from_arrays(columns, self.schema.names)


_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64(),
          T.BooleanType: pa.bool_(), T.DateType: pa.date32()}

#: Kind, width and decimals of a written column.
_KINDS = {T.StringType: ("C", TEXT_WIDTH, 0), T.LongType: ("N", 18, 0), T.DoubleType: ("F", NUMBER_WIDTH, 15),
          T.BooleanType: ("L", 1, 0), T.DateType: ("D", 8, 0)}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Part:
    """The three files of a part while they grow."""

    def __init__(self):
        self.shapes, self.index, self.rows, self.n, self.box = bytearray(), bytearray(), bytearray(), 0, None

    def add(self, shape: list[np.ndarray] | None, row: bytes) -> None:
        if shape is None:
            content = struct.pack("<i", NULL_SHAPE)
        else:
            rings = [r if len(r) and (r[0] == r[-1]).all() and len(r) > 1 else np.concatenate([r, r[:1]]) for r in shape]
            points = np.concatenate(rings) if rings else np.zeros((0, 2))
            box = (*points.min(axis=0), *points.max(axis=0)) if len(points) else (0.0, 0.0, 0.0, 0.0)
            if len(points):
                old = self.box or box
                self.box = (*map(min, old[:2], box[:2]), *map(max, old[2:], box[2:]))
            starts = np.cumsum([0, *(len(r) for r in rings)])[:-1].astype("<i4")
            content = (struct.pack("<i4dii", POLYGON, *box, len(rings), len(points))
                       + starts.tobytes() + points.astype("<f8").tobytes())
        self.index += struct.pack(">ii", (HEADER + len(self.shapes)) // 2, len(content) // 2)
        self.n += 1
        self.shapes += struct.pack(">ii", self.n, len(content) // 2) + content
        self.rows += row

    def header(self, body: int) -> bytes:
        """What both the records and their index begin with; lengths are in units of two bytes."""
        return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, (HEADER + body) // 2) + struct.pack(
            "<2i8d", VERSION, POLYGON, *(self.box or (0.0,) * 4), 0.0, 0.0, 0.0, 0.0)


class RegionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, file_bytes: int):
        self.path, self.overwrite, self.file_bytes = path.rstrip("/"), overwrite, file_bytes
        if schema["rings"].dataType.simpleString() != RINGS.simpleString():
            raise ValueError(f"rings must be {RINGS.simpleString()}")
        self.fields, start = [], 1
        for c in schema.fields:
            if c.name in _OWN:
                continue
            if type(c.dataType) not in _KINDS:
                raise ValueError(f"{c.name}: {c.dataType.simpleString()} has no kind of attribute")
            if len(c.name.encode()) > NAME_BYTES:
                raise ValueError(f"{c.name}: names of attributes have at most {NAME_BYTES} bytes")
            kind, width, decimals = _KINDS[type(c.dataType)]
            self.fields.append(Field(c.name, kind, start, width, decimals))
            start += width
        self.width = start

    def _row(self, values: list) -> bytes:
        cells = [b" "]
        for f, v in zip(self.fields, values):
            if v is None:
                text = b""
            elif f.kind == "L":
                text = b"T" if v else b"F"
            elif f.kind == "D":
                text = v.strftime("%Y%m%d").encode()
            else:
                text = (v if f.kind == "C" else repr(v)).encode()
            if len(text) > f.width:
                raise ValueError(f"{f.name}: a value of {len(text)} bytes does not fit into {f.width}")
            cells.append(text.ljust(f.width) if f.kind == "C" else text.rjust(f.width))
        return b"".join(cells)

    def _table(self, part: _Part) -> bytes:
        """Attribute table: its date is fixed, so that the same rows give the same bytes."""
        columns = b"".join(
            struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.width, f.decimals) for f in self.fields)
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, part.n, 33 + len(columns), self.width)
        return head + columns + b"\r" + bytes(part.rows) + b"\x1a"

    def _save(self, part: _Part) -> str:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        for end, data in (
            ("shp", part.header(len(part.shapes)) + bytes(part.shapes)),
            ("shx", part.header(len(part.index)) + bytes(part.index)),
            ("dbf", self._table(part)), ("cpg", b"UTF-8"),
        ):
            with fs.open_output_stream(f"{folder}/.{name}.{end}") as out:
                out.write(data)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, part = [], _Part()
        for batch in iterator:
            columns = [batch.column(f.name).to_pylist() for f in self.fields]
            for k, shape in enumerate(batch.column("rings")):
                rings = None
                if shape.is_valid:
                    rings = [np.column_stack([r.values.field("x").to_numpy(), r.values.field("y").to_numpy()])
                             for r in shape.values]
                part.add(rings, self._row([c[k] for c in columns]))
                if len(part.shapes) >= self.file_bytes:
                    names.append(self._save(part))
                    part = _Part()
        if part.n:
            names.append(self._save(part))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Old files go first where they are replaced; a name without its ``.shp`` is never listed."""
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(folder)):
                if re.match(r"part-\w+\.(shp|shx|dbf|cpg)$", info.base_name):
                    fs.delete_file(info.path)
        for message in messages:
            for name in message.names if message else ():
                for end in ("cpg", "dbf", "shx", "shp"):
                    fs.move(f"{folder}/.{name}.{end}", f"{folder}/{name}.{end}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        for message in messages:
            for name in message.names if message else ():
                for end in ("cpg", "dbf", "shx", "shp"):
                    if fs.get_file_info(f"{folder}/.{name}.{end}").type == pafs.FileType.File:
                        fs.delete_file(f"{folder}/.{name}.{end}")


class RegionSource(DataSource):
    """Options: ``path``, ``encoding``, ``records`` of a partition, ``batch_bytes``, ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "regions"

    def _number(self, name: str, default: int) -> int:
        value = int(self.options.get(name, default))
        if value < 1:
            raise ValueError(f"{name} must be at least 1")
        return value

    def _files(self) -> list[str]:
        path = self.options["path"]
        if path.lower().endswith(".shp"):
            return [path]
        fs, folder = _open(path)
        prefix = path.rstrip("/")
        found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder))]
        return [f"{prefix}/{n}" for n in sorted(found) if n.lower().endswith(".shp") and n[0] not in "._"]

    def schema(self) -> T.StructType:
        """The columns of all files, in the order in which they turn up; whole numbers widen to fractions."""
        found: dict[str, T.StructField] = {}
        for file in self._files():
            for f in Files(file, "utf-8").fields()[2]:
                key, type_ = f.column.lower(), f.type
                if key in found and found[key].dataType != type_:
                    both = {type(found[key].dataType), type(type_)}
                    if both != {T.LongType, T.DoubleType}:
                        raise ValueError(f"{f.name} has different types in the files of {self.options['path']}")
                    type_ = T.DoubleType()
                name = found[key].name if key in found else f.column
                found[key] = T.StructField(name, type_)
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("record", T.LongType()),
                             *found.values(), T.StructField("rings", RINGS)])

    def reader(self, schema: T.StructType) -> RegionReader:
        return RegionReader(self._files(), schema, self.options.get("encoding", "utf-8"),
                            self._number("records", 1_000), self._number("batch_bytes", 8 << 20))

    def writer(self, schema: T.StructType, overwrite: bool) -> RegionWriter:
        return RegionWriter(self.options["path"], schema, overwrite, self._number("file_bytes", 64 << 20))


def read_regions(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, record, attributes, rings) of a file or a folder of files."""
    spark.dataSource.register(RegionSource)
    return spark.read.format("regions").options(**options).load(path)


def write_regions(regions: DataFrame, path: str, mode: str = "append", **options) -> None:
    """``rings`` and attributes as files of a folder; ``file`` and ``record`` are given anew."""
    regions.sparkSession.dataSource.register(RegionSource)
    regions.drop("file", "record").write.format("regions").mode(mode).options(**options).save(path)


def region_vertices(regions: DataFrame, key: str) -> DataFrame:
    """(poly_id, ring_id, seq, x, y); the rings of all records with the same key are numbered on.

    Records without a key or a shape have no vertices.
    """
    before = Window.partitionBy("poly_id").orderBy("file", "record").rowsBetween(Window.unboundedPreceding, -1)
    return (
        regions.select(F.col(key).cast("string").alias("poly_id"), "file", "record", "rings")
        .where(F.col("poly_id").isNotNull() & F.col("rings").isNotNull())
        .withColumn("first", F.coalesce(F.sum(F.size("rings")).over(before), F.lit(0)))
        .select("poly_id", "first", F.posexplode("rings").alias("ring", "points"))
        .select("poly_id", (F.col("first") + F.col("ring")).cast("int").alias("ring_id"),
                F.posexplode("points").alias("seq", "p"))
        .select("poly_id", "ring_id", "seq", "p.x", "p.y")
    )


def read_region_edges(spark: SparkSession, path: str, key: str, **options) -> DataFrame:
    """Directed edges of the regions, as point in polygon and coverage take them."""
    return polygon_edges(region_vertices(read_regions(spark, path, **options), key))


def regions_of(vertices: DataFrame) -> DataFrame:
    """Vertices -> one row per region with its rings in order; a row is one region's outline."""
    points = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    rings = vertices.groupBy("poly_id", "ring_id").agg(
        F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    ordered = F.sort_array(F.collect_list(F.struct("ring_id", "ring")))
    return rings.groupBy("poly_id").agg(F.transform(ordered, lambda r: r["ring"]).alias("rings"))
