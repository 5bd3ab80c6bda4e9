"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (how often the mix should take it) such that the words taken
of each source meet the source's target. Of all such rates those closest in entropy to 1
are chosen: the convex dual has one multiplier for each source, and the rates are
exponentially tilted, ``min(cap, exp(multiplier * size / mean size))``. The multipliers
come from Newton steps, kept inside a bracket; each step is one Spark aggregation.

Documents of one source and size share a rate, so the steps run over counts of (source,
size) and not over documents. Rates become whole copies by systematic rounding along the
sizes of a source: copies and rates differ by less than 1 in every prefix, so a source's
words miss its target by at most about its longest document. ``repairs`` times, one
document of each source then gets a copy more or less, the longest that the gap has room
for, which leaves gaps of a few words. Within a size the order is a
hash of the id; a size with very many documents is dealt to several blocks of about
``block`` rows, so that no source, size or group of copies is ever ranked in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 take no words; a source whose target is its cap takes every
document ``cap`` times; repeated rows are counted and rounded as rows. No document is
taken more than ``cap`` times. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafclock.llm.common import WORD, columns_of, fresh
from leafclock.sources.scratch import staged


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with size the number of words."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def cyclic_weights(sources: DataFrame, period: int = 3) -> DataFrame:
    """(source, weight): 1, 2, ... ``period``, repeating, by code point with null last.

    Ranks the distinct sources, one short row each, in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source").distinct().select(
        "source", (F.pmod(F.row_number().over(order) - 1, F.lit(period)) + 1).cast("double").alias("weight"))


def targets(totals: DataFrame, weights: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target): all words shared by weight, none above ``cap`` times its source.

    Sharing the excess again and again ends at one level L with target = min(cap * size,
    L * weight). Sources are capped in the order of cap * size / weight; L is what is left
    over the weights that are left, at the first source that stays below its cap.
    """
    t = totals.alias("t").join(weights.alias("w"), _same(F.col("t.source"), F.col("w.source"))).select(
        "t.source", "t.source_size", "w.weight", (F.col("t.source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after))
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    t = t.withColumn("level", F.first(free, ignorenulls=True).over(everything))
    return t.select(
        "source", F.col("source_size"),
        F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _exact(c: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree."""
    return F.sum(c.cast("decimal(28,8)")).cast("double")


def multipliers(counts: DataFrame, goals: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """(source, mean, multiplier) solving the dual; null where the target is the cap itself.

    ``counts`` is (source, size, n). Words taken grow with the multiplier, so a bracket is
    kept; a Newton step that leaves it is replaced by its middle, or by a doubling while
    it is open. The state, one row for each source, is written after every step.
    """
    log_cap = F.log(F.lit(cap))
    mean = counts.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.alias("g").join(mean.alias("a"), _same(F.col("g.source"), F.col("a.source"))).where(
        F.col("target") < F.col("source_size") * cap).select(
        "g.source", "target", "mean", F.lit(0.0).alias("m"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    state = staged(state.coalesce(1), "dual")
    for _ in range(steps):
        s = state.alias("s")
        c = counts.where("size > 0").alias("c")
        x = F.col("c.size") / F.col("s.mean")
        rate = F.exp(F.least(F.col("s.m") * x, log_cap))
        words = F.col("c.size") * F.col("c.n") * rate
        free = F.when(F.col("s.m") * x < log_cap, words * x)
        sums = c.join(s, _same(F.col("c.source"), F.col("s.source"))).groupBy(
            F.col("s.source").alias("source")
        ).agg(_exact(words).alias("taken"), F.coalesce(_exact(free), F.lit(0.0)).alias("slope"),
              *(F.first(F.col(f"s.{k}")).alias(k) for k in ("target", "mean", "m", "low", "high", "done")))
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("m")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.try_divide(gap, F.col("slope"))
        middle = F.when(
            F.col("l").isNull(), F.col("h") - F.greatest(F.lit(1.0), F.abs("h"))
        ).when(F.col("h").isNull(), F.col("l") + F.greatest(F.lit(1.0), F.abs("l"))).otherwise((F.col("l") + F.col("h")) / 2)
        inside = (F.col("step").isNotNull() & F.coalesce(F.col("step") > F.col("l"), F.lit(True))
                  & F.coalesce(F.col("step") < F.col("h"), F.lit(True))
                  & (F.abs(F.col("step") - F.col("m")) < 8 + F.abs("m")))
        state = staged(sums.select(
            "source", "target", "mean", "m", low.alias("l"), high.alias("h"), newton.alias("step"),
            (F.abs(gap) <= tolerance * F.col("target")).alias("met"),
        ).select(
            "source", "target", "mean",
            F.when(F.col("met"), F.col("m")).when(inside, F.col("step")).otherwise(middle).alias("m"),
            F.col("l").alias("low"), F.col("h").alias("high"), F.col("met").alias("done"),
        ).coalesce(1), "dual")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "mean", F.col("m").alias("multiplier"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, cap: int = 3, steps: int = 40,
        tolerance: float = 1e-6, block: int = 8_192, repairs: int = 2,
        keep_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) of every row.

    ``weights`` is (source, weight); without it the sources weigh 1, 2, 3, repeating.
    ``taken`` is size times copies.
    """
    rows = staged(sizes(docs), "sizes")
    counts = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = staged(targets(totals, weights if weights is not None else cyclic_weights(totals), cap).coalesce(1), "goals")
    dual = multipliers(counts, goals, cap, steps, tolerance)

    c, g, d = counts.alias("c"), goals.alias("g"), dual.alias("d")
    rated = c.join(g, _same(F.col("c.source"), F.col("g.source"))).join(
        d, _same(F.col("c.source"), F.col("d.source")), "left").select(
        "c.source", "c.size", "c.n", "g.source_size", "g.target",
        F.when(F.col("c.size") == 0, F.lit(0.0)).when(F.col("d.multiplier").isNull(), F.lit(float(cap))).otherwise(
            F.exp(F.least(F.col("d.multiplier") * F.col("c.size") / F.col("d.mean"), F.log(F.lit(float(cap)))))
        ).alias("rate"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = staged(rated.withColumn(
        "before", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(upto), F.lit(0.0))), "rates")

    r = rated.alias("r")
    rows = rows.alias("x").join(r, _same(F.col("x.source"), F.col("r.source")) & (F.col("x.size") == F.col("r.size"))).select(
        "x.doc_id", "x.source", "x.size", "r.n", "r.source_size", "r.target", "r.rate", "r.before")
    blocks = F.ceil(F.col("n") / block)
    rows = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(7))).withColumn("block", F.pmod("draw", blocks))
    place = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("draw", "doc_id"))
    start = F.col("before") + F.col("rate") * F.col("n") * F.col("block") / blocks + 0.5
    until = lambda k: F.floor(F.round(start + F.col("rate") * k, 6))  # noqa: E731  the same for equal sums
    rows = rows.withColumn("place", place)
    copies = F.least(until(F.col("place")) - until(F.col("place") - 1), F.lit(cap)).cast("long")
    rows = staged(rows.withColumn("copies", copies).drop("n", "before", "draw"), "rounded")
    for _ in range(repairs):
        rows = _repaired(rows, cap)
    return rows.select(
        "doc_id", *["source"] * keep_source, "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def _repaired(rows: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of one document in each source: the longest that its gap has room for."""
    gap = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    r, g = rows.alias("r"), gap.alias("g")
    room = F.when(F.col("g.gap") > 0, F.col("r.copies") < cap).otherwise(F.col("r.copies") > 0)
    fits = (F.col("r.size") > 0) & (F.col("r.size") <= F.abs("g.gap"))
    best = r.join(g, _same(F.col("r.source"), F.col("g.source"))).where(room & fits).groupBy("r.source").agg(
        F.max(F.struct("r.size", "r.block", "r.place")).alias("at"), F.first(F.signum("g.gap")).cast("long").alias("more"))
    best = staged(best.coalesce(1), "repairs")
    b, r = best.alias("b"), rows.alias("r")
    hit = (_same(F.col("r.source"), F.col("b.source")) & (F.col("r.size") == F.col("b.at.size"))
           & (F.col("r.block") == F.col("b.at.block")) & (F.col("r.place") == F.col("b.at.place")))
    return r.join(b, hit, "left").select(
        *(f"r.{c}" for c in rows.columns if c != "copies"),
        (F.col("r.copies") + F.coalesce("b.more", F.lit(0))).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    size, nth, copy = (fresh(docs, name) for name in ("_size", "_nth", "_copy"))
    key = ["doc_id", "source", size]
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    # Rows with the same id, source and size are told apart by their place.
    place = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    sized = sized.withColumn(nth, place(F.xxhash64("text")))
    taken = mix(docs, keep_source=True, **how).select(
        "doc_id", "source", F.col("size").alias(size), "copies").withColumn(nth, place("copies"))
    a, b = sized.alias("a"), taken.where("copies > 0").alias("b")
    both = a.join(b, _same(F.col("a.doc_id"), F.col("b.doc_id")) & _same(F.col("a.source"), F.col("b.source"))
                  & (F.col(f"a.{size}") == F.col(f"b.{size}")) & (F.col(f"a.{nth}") == F.col(f"b.{nth}")))
    times = F.explode(F.array_repeat(F.lit(0), F.col("b.copies").cast("int"))).alias(copy)
    return both.select("a.*", times).select(*columns_of(docs))
