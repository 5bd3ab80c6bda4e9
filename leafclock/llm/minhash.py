"""Near duplicates: MinHash bands, sequential Bayesian verification, exact check, components.

1. Every text becomes the set of its distinct word shingles and a MinHash signature.
   Texts with equal sets are one class; all further work is on classes.
2. Bands of the signature put classes in buckets. In each bucket the class that shares
   most buckets is the hub, and the others are compared with it alone. A comparison takes
   the signatures in batches and drops a pair once its posterior chance of reaching the
   threshold is below ``miss``; what survives is checked on the full sets.
3. Members that are not linked with their hub may still be linked with each other or with
   other members. They are compared with all members of the hub in blocks of about
   ``block`` rows, unless a link between their components is known. Blocks return links that join
   two components, never pairs; within a component no more links are needed.
4. Components come from alternating stars over the links.

A hub with very many members is dealt to many (hub, block) tasks; copies were merged in
step 1. What a join looks up for a hot key is written first, so that it is broadcast if it is
short, and else the hot side can be split. A pair at the threshold shares no bucket with a chance of (1 - t^rows)^bands,
7e-9 at t = 0.85 with the defaults; nothing else is approximate but ``miss``.

Defined results: null and empty texts, and texts without words, have no shingles and are
linked with nothing; texts of fewer words than ``width`` are one shingle; rows with
the same id and text are both kept by ``near_duplicates`` if the id is its component's
smallest, ``keep_one`` keeps one of them; a null id never becomes a component id unless
all ids of the component are null. Other columns are ignored (kept by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafclock.llm.common import WordHashes, columns_of, fresh, map_batches, over_batches, texts, with_column
from leafclock.llm.components import components
from leafclock.llm.shingles import MinHash, least_matches, sequential, set_id, shingle_set
from leafclock.sources.scratch import staged


def signatures(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(doc_id, cid, n, sig): class of the set, its size, and its signature; cid and sig null without shingles."""
    hashes, minhash = WordHashes(), MinHash(size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width, hashes) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"),
            pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([minhash.of(s) if len(s) else None for s in sets], pa.binary()),
        ], ["doc_id", "cid", "n", "sig"])

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, cid long, n long, sig binary")


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, cid, n) for buckets with two classes or more; n is the bucket's size."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows))))
    spread = classes.select("cid", F.explode(bits).alias("key"))
    shared = staged(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    return staged(spread.join(shared, "key"), "buckets")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, sig, words) of the wanted classes, words being the full set as bytes.

    ``wanted`` is (cid, doc_id, sig), one document for each class.
    """
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width, hashes) for t in texts(batch)]
        ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
        same = pa.compute.equal(ids, batch.column("cid"))
        out = pa.RecordBatch.from_arrays(
            [batch.column("cid"), batch.column("sig"), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["cid", "sig", "words"])
        return out.filter(pa.compute.fill_null(same, False))

    w, d = wanted.where("doc_id is not null").alias("w"), docs.select("doc_id", "text").alias("d")
    both = d.join(w, F.col("d.doc_id") == F.col("w.doc_id")).select("d.text", "w.cid", "w.sig")
    found = over_batches(both, run, "cid long, sig binary, words binary")

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for s in (shingle_set(t, width, hashes) for t in texts(batch)) if len(s)]
        return pa.RecordBatch.from_arrays([
            pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "words"])

    # Classes without any id are found by their set, each row once.
    rows = over_batches(docs.where("doc_id is null").select("text"), named, "cid long, words binary")
    nameless = rows.join(wanted.where("doc_id is null").select("cid", "sig"), "cid").select("cid", "sig", "words")
    # An id may have several rows; one of those with the class's text is enough.
    return found.unionByName(nameless).groupBy("cid").agg(F.first("sig").alias("sig"), F.first("words").alias("words"))


class _Rows:
    """Classes of a batch: ids, signature matrix and sets."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("cid").to_numpy(zero_copy_only=False)
        self.sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(self.ids), -1)
        self.words = batch.column("words")

    def set(self, i: int) -> np.ndarray:
        return np.frombuffer(self.words[i].as_buffer(), np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch in runs of equal keys."""
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    change = np.zeros(batch.num_rows, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield tuple(c[a] for c in columns), batch.slice(a, b - a)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys next to each other, those of kind 0 first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "kind", "cid")


def _hub_links(star: DataFrame, sets: DataFrame, rule: list, percent: int, block: int) -> DataFrame:
    """(hub, cid, near) for every pair of ``star`` (hub, cid, m), m being the hub's members."""
    parts = F.ceil(F.col("m") / block).cast("int")
    members = star.select("hub", "cid", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), F.lit(1).alias("kind"))
    hubs = star.groupBy("hub").agg(F.max("m").alias("m")).select(
        "hub", F.col("hub").alias("cid"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sig = words = None
        for batch in batches:
            for key, part in _runs(batch, ("hub", "part")):
                rows, kinds = _Rows(part), part.column("kind").to_numpy(zero_copy_only=False)
                if kinds[0] == 0:
                    at, sig, words = key, rows.sigs[:1].copy(), rows.set(0).copy()
                assert at == key
                which = np.flatnonzero(kinds)
                keep = sequential(rows.sigs, sig, which, np.zeros_like(which), rule)
                near = [bool(k) and _linked(words, rows.set(i), percent) for i, k in zip(which, keep)]
                if len(which):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(which), key[0]), pa.int64()), pa.array(rows.ids[which], pa.int64()),
                        pa.array(near, pa.bool_())], ["hub", "cid", "near"])

    rows = _dealt(members.union(hubs).join(sets, "cid"), "hub", "part")
    return map_batches(rows, run, "hub long, cid long, near boolean")


def _block_links(tried: DataFrame, roots: DataFrame, sets: DataFrame, rule: list, percent: int, block: int) -> DataFrame:
    """(a, b) links between components of the members of one hub; ``tried`` is (hub, cid, near)."""
    r = roots.select(F.col("node").alias("cid"), "root")
    placed = tried.join(r, "cid", "left").select(
        "hub", "cid", "near", F.coalesce("root", "cid").alias("root"))
    open_hubs = placed.groupBy("hub").agg(
        F.count("*").alias("m"), F.count_if(~F.col("near")).alias("q"),
        F.min("root").alias("low"), F.max("root").alias("high")).where("q > 0 and m > 1 and low < high")
    open_hubs = staged(open_hubs, "open-hubs")
    placed = placed.join(open_hubs.select("hub", "m", "q"), "hub")
    parts = F.ceil(F.col("m") / block).cast("int")
    blocks = F.ceil(F.col("q") / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = placed.where("not near").select(
        "hub", "cid", "near", "root", own(blocks).alias("block"), count(parts).alias("part"), F.lit(0).alias("kind"))
    asked = placed.select(
        "hub", "cid", "near", "root", count(blocks).alias("block"), own(parts).alias("part"), F.lit(1).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, joined = None, [], {}

        def find(x):
            while joined.setdefault(x, x) != x:
                joined[x] = joined[joined[x]]
                x = joined[x]
            return x

        for batch in batches:
            found = []
            for key, part in _runs(batch, ("hub", "block", "part", "kind")):
                if key[:3] != at:
                    at, held, joined = key[:3], [], {}
                rows = _Rows(part), part.column("root").to_numpy(zero_copy_only=False), ~part.column("near").to_numpy(
                    zero_copy_only=False)
                if key[3] == 0:
                    held.append(rows)
                    continue
                for q, q_roots, _ in held:
                    y, y_roots, y_asks = rows
                    step = max(1, (1 << 17) // len(q.ids))
                    for s in range(0, len(y.ids), step):
                        e = s + step
                        # Of two that both ask, the smaller id asks.
                        apart = (q_roots[:, None] != y_roots[None, s:e]) & (
                            ~y_asks[None, s:e] | (q.ids[:, None] < y.ids[None, s:e]))
                        i, j = np.nonzero(apart)
                        keep = sequential(q.sigs, y.sigs[s:e], i, j, rule)
                        for a, b in zip(i[keep].tolist(), (j[keep] + s).tolist()):
                            ra, rb = find(q_roots[a]), find(y_roots[b])
                            if ra != rb and _linked(q.set(a), y.set(b), percent):
                                joined[ra] = rb
                                found.append((q_roots[a], y_roots[b]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = _dealt(asking.union(asked).join(sets, "cid"), "hub", "block", "part")
    return map_batches(rows, run, "a long, b long")


def _classes(docs: DataFrame, width: int, percent: int, bands: int, rows: int, batch: int, miss: float,
             block: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (cid, root, component_id) of every class."""
    rule = least_matches(bands * rows, batch, percent / 100, miss)
    signed = staged(signatures(docs, width, bands * rows), "signatures")
    classes = staged(signed.where("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    shared = _buckets(classes, bands, rows)
    degree = shared.groupBy("cid").agg(F.sum("n").alias("degree"))
    placed = shared.join(degree, "cid")
    hubs = staged(placed.groupBy("key").agg(F.max(F.struct("degree", "cid"))["cid"].alias("hub")), "hubs")
    star = staged(shared.join(hubs, "key").where("cid <> hub").select("hub", "cid").distinct(), "stars")
    star = star.join(staged(star.groupBy("hub").agg(F.count("*").alias("m")), "hub-sizes"), "hub")

    wanted = classes.join(degree.select("cid"), "cid").select("cid", F.col("rep").alias("doc_id"), "sig")
    sets = staged(_sets(docs, wanted, width), "sets")
    tried = staged(_hub_links(star, sets, rule, percent, block), "tried")
    roots = components(tried.where("near").select(F.col("hub").alias("a"), F.col("cid").alias("b")))
    more = components(_block_links(tried, roots, sets, rule, percent, block))

    # node -> root of the first links -> root of the roots
    first, second = roots.alias("f"), more.alias("s")
    deep = first.join(second, F.col("f.root") == F.col("s.node"), "left").select(
        F.col("f.node").alias("cid"), F.coalesce("s.root", "f.root").alias("root"))
    own = second.join(first, F.col("f.node") == F.col("s.node"), "left_anti").select(
        F.col("s.node").alias("cid"), F.col("s.root").alias("root"))
    root_of = deep.union(own)
    grouped = classes.select("cid", "rep").join(root_of, "cid", "left").select(
        "cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed, staged(grouped.join(least, "root").select("cid", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5,
                    batch: int = 16, miss: float = 1e-6, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked if their sets' intersection is at least ``percent`` of their union;
    ``component_id`` is the smallest id that links reach, ``kept`` marks that row.
    """
    signed, classes = _classes(docs, width, percent, bands, rows, batch, miss, block)
    out = signed.select("doc_id", "n", "cid").join(classes.select("cid", "component_id"), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5,
             batch: int = 16, miss: float = 1e-6, block: int = 512) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each group of near duplicates.

    The row with the group's smallest id stays; rows without an id come after all others, and of
    rows with one id the one whose set has the least hash. A repeated id whose
    texts are unlike keeps one row of each. Rows without shingles all stay.
    """
    signed, classes = _classes(docs, width, percent, bands, rows, batch, miss, block)
    hashes = WordHashes()
    cid = lambda ts: np.array([set_id(s) if len(s) else 0 for s in (shingle_set(t, width, hashes) for t in ts)], np.int64)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "cid")
    winners = signed.select("doc_id", "cid").join(classes.select("cid", "root"), "cid").groupBy("root").agg(
        F.min(order).alias("at"))
    winners = staged(winners.select("at.doc_id", "at.cid"), "winners")
    own, key, place = [fresh(docs, name) for name in ("_own", "_key", "_place")]
    here = columns_of(docs)

    # An id of one row tells the row; others are told by their texts, hashed again.
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("cid").alias("cid"))
    stay = ids.where("n = 1 and cid is null").select("doc_id").union(winners.join(
        ids.where("n = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id"))
    single = docs.join(stay.withColumnRenamed("doc_id", key), F.col("doc_id") == F.col(key), "left_semi")
    repeated = ids.where("n > 1").select(F.col("doc_id").alias(key))
    several = docs.join(repeated, F.col("doc_id") == F.col(key), "left_semi").unionByName(docs.where("doc_id is null"))
    several = with_column(several, own, "long", cid)
    w = winners.select(F.col("doc_id").alias(key), F.col("cid").alias(place))
    first = Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*here))
    chosen = several.join(w, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(place)), "left_semi").withColumn(
        place, F.row_number().over(first)).where(F.col(place) == 1)
    empty = several.where(F.col(own) == 0)
    return single.select(*here).unionByName(chosen.select(*here)).unionByName(empty.select(*here))
