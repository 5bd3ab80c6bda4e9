"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf. The leaves of a group ascend by an id, and every ``arity`` consecutive
nodes have a parent until one is left, the group's subroot; the subroots, by group, have a
tree of their own, whose top is the root. A parent's digest is the SHA-256 of its children's
digests, as hex text.

Nodes are labelled (level, place). They are visited in the order of their labels: a node
takes from a priority queue what its children have sent to its label, and sends its digest to
its parent's label. Then the sweep is reversed: a node takes the proof of its parent, a list
of what stands to the left and right on each level up to the root, puts its own siblings in
front and sends that to its children, down to the leaves.

A tree is cut into blocks of ``arity ** height`` neighbours. A task sweeps one block, and what leaves
a block (the digest of its top, the proof for it) goes to the next round of blocks through
a table, so that no task's work grows with the data: 2 ** 30 leaves take three rounds of
height 10. The queue is external: past ``hold`` messages its larger half goes as a sorted run to
a file in the working folder, read back a little at a time, so taller blocks need no more memory for it.

Places come from a sort by range: the rows of a partition are numbered by Spark, and only the
counts of (partition, group) are summed up, so that a group with most of the rows is spread
over many tasks.

Defined results: a null value is written ``-``; leaves with equal ids stand in the order of
their digests, rows without an id come first, and so does the group null. Repeated rows are
leaves of their own. The proof of a lone leaf of a lone group is empty; a node that is alone in its run has no siblings, but its parent is
its digest's digest all the same. An empty table has no leaves and
no root. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafclock.llm.arrays import _open
from leafclock.sources.scratch import scratch_dir, staged

#: What stands beside a node on every level up to the root, the lowest first; nothing beside a lone node of a run.
PROOF = "array<struct<left:string,right:string>>"


def written(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*map(written, values)).cast("binary"), 256)


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


@dataclass
class ExternalQueue:
    """A priority queue of (label, message) that holds at most ``hold`` entries in memory."""

    hold: int
    folder: str
    heap: list = field(default_factory=list)
    runs: list = field(default_factory=list)
    spilled: int = 0

    def push(self, label: tuple, message) -> None:
        if len(self.heap) >= self.hold:
            self._spill()
        heapq.heappush(self.heap, (label, message))

    def _spill(self) -> None:
        """Writes the larger half as a sorted run in chunks, and opens the run at its first chunk."""
        entries = sorted(self.heap)
        self.heap, rest = entries[:len(entries) // 2], entries[len(entries) // 2:]
        fs, path = _open(f"{self.folder}/{uuid.uuid4().hex}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for i in range(0, len(rest), 1024):
                data = pickle.dumps(rest[i:i + 1024], pickle.HIGHEST_PROTOCOL)
                out.write(len(data).to_bytes(8, "little") + data)
        self.spilled += 1
        run = self._read(fs, path)
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _read(fs, path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path) as source:
            while head := source.read(8):
                yield from pickle.loads(source.read(int.from_bytes(head, "little")))
        fs.delete_file(path)

    def _next(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def take(self, label: tuple) -> list:
        """The messages sent to the label, in their order; earlier labels must have been taken."""
        out = []
        while (least := self._next()) is not None and least[0] == label:
            if self.runs and least is self.runs[0][0]:
                _, number, run = self.runs[0]
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (following, number, run))
            else:
                heapq.heappop(self.heap)
            out.append(least[1])
        return out


@dataclass(frozen=True)
class Sweep:
    """Sweeps over one block."""

    arity: int
    hold: int
    folder: str

    def up(self, leaves: list[str], levels: int | None) -> list[list[str]]:
        """The digests of all levels; ``levels`` of them above the leaves, or up to a single node."""
        queue = ExternalQueue(self.hold, self.folder)
        done, level, n = [], 0, len(leaves)
        while True:
            row = []
            last = n == 1 if levels is None else level == levels
            for place in range(n):
                own = leaves[place] if not level else digest([d for _, d in queue.take((level, place))])
                row.append(own)
                if not last:
                    queue.push((level + 1, place // self.arity), (place, own))
            done.append(row)
            if last:
                return done
            level, n = level + 1, -(-n // self.arity)

    def down(self, rows: list[list[str]], top: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
        """The proofs of the leaves, from that of the block's top."""
        queue, k = ExternalQueue(self.hold, self.folder), self.arity
        queue.push((0, 0), top)
        for depth, row in enumerate(reversed(rows)):
            below = rows[-2 - depth] if depth + 1 < len(rows) else None
            for place in range(len(row)):
                (proof,) = queue.take((depth, place))
                if below is None:
                    yield proof
                    continue
                run = below[place * k:(place + 1) * k]
                for i in range(len(run)):
                    beside = "".join(run[:i]), "".join(run[i + 1:])
                    queue.push((depth + 1, place * k + i), [beside, *proof])


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (grp, key, digest, row) with ``place`` from 0 in their group and the group's number ``n``.

    The order is that of key and digest; which of several equal rows comes first makes no
    difference to any of them, so they may fall to several partitions.
    """
    order = ["grp", "key", "digest", "own"]
    rows = rows.withColumn("own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("own")
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part"), F.col("grp").alias("name")).agg(
        F.min("at").alias("first"), F.count("*").alias("count"))
    group = Window.partitionBy("name")
    upto = F.sum("count").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = staged(counts.select("part", "name", (F.col("first") - upto + F.col("count")).alias("shift"),
                                  F.sum("count").over(group).alias("n")), "places")
    here = (part == F.col("part")) & F.col("grp").eqNullSafe(F.col("name"))
    return rows.join(counts, here).select("grp", (F.col("at") - F.col("shift")).alias("place"), "digest", "n", "row")


def _kind(nodes: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names)


def _levels(n: int, block: int, height: int) -> int | None:
    """Levels above the lowest nodes of a block; None: up to the top of the tree."""
    return None if n <= block else height


def _sorted(nodes: pa.Table) -> pa.Table:
    return nodes.take(np.argsort(nodes["place"].to_numpy(), kind="stable"))


def _with_proofs(nodes: pa.Table, proofs: list[list[tuple[str, str]]]) -> pa.Table:
    flat = [x for p in proofs for x in p]
    ends = np.cumsum([0, *map(len, proofs)], dtype=np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["left", "right"])
    return nodes.append_column("proof", pa.ListArray.from_arrays(pa.array(ends), pairs))


@dataclass(frozen=True)
class Trees:
    """The trees of all groups; rounds[r] are the lowest nodes (grp, place, digest, n) of its blocks."""

    rounds: list[DataFrame]
    sweep: Sweep
    height: int

    @property
    def tops(self) -> DataFrame:
        """(grp, digest) of the trees' tops."""
        return self.rounds[-1].select("grp", "digest")

    def proofs(self, tops: DataFrame) -> DataFrame:
        """(grp, row, proof) of all leaves; ``tops`` is (grp, proof) of every tree."""
        sweep, height, block = self.sweep, self.height, self.sweep.arity ** self.height

        def run(nodes: pa.Table, top: pa.Table) -> pa.Table:
            nodes = _sorted(nodes)
            proofs = []
            if nodes.num_rows:
                start = [(x["left"], x["right"]) for x in top["proof"][0].as_py()]
                rows = sweep.up(nodes["digest"].to_pylist(), _levels(nodes["n"][0].as_py(), block, height))
                proofs = list(sweep.down(rows, start))
            return _with_proofs(nodes.select([c for c in nodes.column_names if c not in ("digest", "n", "block")]), proofs)

        above = tops.select("grp", F.lit(0).cast("long").alias("block"), "proof")
        # The top round has one node for every tree; where it is the only one, the leaves are the tops.
        for nodes in reversed(self.rounds[:-1] or self.rounds):
            carried = [c for c in nodes.columns if c not in ("digest", "n")]
            below = _in_blocks(nodes, block).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(
                run, f"{_kind(nodes, *carried)}, proof {PROOF}")
            if nodes is not self.rounds[0]:
                above = staged(below.select("grp", F.col("place").alias("block"), "proof"), "proofs")
        return below.select("grp", "row", "proof")


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(block)).cast("long"))


def trees(nodes: DataFrame, arity: int = 2, height: int = 10, hold: int = 1 << 16) -> Trees:
    """Trees over (grp, place, digest, n, row): round after round of blocks, each round written."""
    if arity < 2 or height < 1 or hold < 2:
        raise ValueError("arity and hold from 2, height from 1")
    sweep = Sweep(arity, hold, scratch_dir(nodes.sparkSession, "queue"))
    block = arity ** height

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table["n"][0].as_py()
        rows = sweep.up(table["digest"].to_pylist(), _levels(n, block, height))
        return pa.table({"grp": table["grp"].slice(0, 1), "place": [key[1].as_py()], "digest": rows[-1], "n": [-(-n // block)]})

    rounds = [staged(nodes, "nodes")]
    most = rounds[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        nodes = _in_blocks(rounds[-1].select("grp", "place", "digest", "n"), block)
        rounds.append(staged(nodes.groupBy("grp", "block").applyInArrow(
            run, f"{_kind(nodes, 'grp')}, place long, digest string, n long"), "nodes"))
        most = -(-most // block)
    return Trees(rounds, sweep, height)


def manifest(leaves: DataFrame, group: str, order: str, **how) -> DataFrame:
    """All columns of ``leaves``, and (subroot, root, proof) of every row.

    ``leaves`` has a column ``leaf``, the row's digest; a tree's leaves have the same
    ``group`` and ascend by ``order``. ``how``: arity, height and hold, see the module.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in leaves.columns)).alias("row")
    own = trees(ranked(leaves.select(
        F.col(group).alias("grp"), F.col(order).alias("key"), F.col("leaf").alias("digest"), row)), **how)
    named = F.struct(F.col("grp").alias("name"), F.col("digest").alias("subroot")).alias("row")
    whole = trees(ranked(own.tops.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "digest", named)), **how)
    top = whole.tops.first()
    tops = staged(whole.proofs(whole.tops.select("grp", F.array().cast(PROOF).alias("proof"))).select(
        "row.name", "row.subroot", "proof"), "tops")
    proofs = own.proofs(tops.select(F.col("name").alias("grp"), "proof"))
    return proofs.join(tops.select("name", "subroot"), F.col("grp").eqNullSafe(F.col("name"))).select(
        "row.*", "subroot", F.lit(top.digest if top else None).cast("string").alias("root"), "proof")


def siblings(proof: str | Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf_digest: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and its proof lead to."""
    start = F.col(leaf_digest) if isinstance(leaf_digest, str) else leaf_digest
    return F.aggregate(proof, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def audit(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
          group: str = "lang", order: str = "doc_id", count: str = "n_chars", every: int = 7, **how) -> DataFrame:
    """A proof of every row, checked after some rows were tampered with.

    Where ``every`` divides the CRC-32 of the id as text, ``count`` is one larger in what is
    checked; a null count stays. (doc_id, leaf, subroot, root, proof, folded_root, verified).
    """
    plain = [F.col(c) for c in columns]
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == count else F.col(c) for c in columns]
    hit = F.crc32(F.col(order).cast("string").cast("binary")) % every == 0
    # Written, as the sort reads its input twice: once to find the ranges.
    leaves = staged(docs.select(F.col(order), F.col(group), leaf(*plain).alias("leaf"),
                                F.when(hit, leaf(*more)).alias("tampered")), "digests")
    checked = manifest(leaves, group, order, **how)
    root = folded(F.coalesce("tampered", "leaf"), "proof")
    return checked.select(order, "leaf", "subroot", "root", "proof", root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    return audit(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof").cast("binary"), 256).alias(
        "proof_sha256"), "folded_root", "verified")
