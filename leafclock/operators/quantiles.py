"""Exact quantiles of columns with any number of different values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafclock.sources.scratch import staged


def _same(a: str, b: str, keys) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _bin(bins: int) -> Column:
    """Number of the equal bin of [low, high] that holds a value; both ends are in bins of their own."""
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    # Halved, as the range itself may not be finite.
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.least(F.greatest(F.floor(share * (bins - 2)), F.lit(0)), F.lit(bins - 3)).cast("int") + 1
    endless = (low == float("-inf")) | (high == float("inf"))
    return F.when(v == low, 0).when(v == high, bins - 1).when(endless, 1).otherwise(inner)


def quantile_table(
    df: DataFrame, keys, column: str, probs: dict, bins: int = 1024, few: int = 10_000
) -> DataFrame:
    """The keys and one column per entry of ``probs`` (name -> probability), by linear interpolation.

    A quantile lies between the values at two ranks. A group's values are counted in equal bins of
    its range; the bin that holds a rank becomes the new range, and so on, until a range is a
    single value or holds at most ``few``, which are then ranked. Bins are counted on
    the map side, so no task holds a group's values, and each round at least takes away a range's two
    ends, in practice all but one bin in a thousand. Null and NaN are missing; a group without values has
    null quantiles. Rows are read once and kept as (keys, value).
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    value = F.col(column).cast("double")
    values = staged(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(0).alias("k"),
                              F.when(~F.isnan(value), value).alias("value")), "values")
    on = [*names, "k"]
    totals = staged(values.groupBy(*on).agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "ranges")
    at = F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), (F.floor((F.col("n") - 1) * F.lit(float(p))) + step).alias("rank"), F.lit(step).alias("step"))
        for name, p in probs.items() for step in (0, 1)]))
    ranks = totals.where("n > 0").select(*on, "n", "low", "high", at.alias("t")).select(
        *on, "t.name", "t.step", F.least("t.rank", F.col("n") - 1).alias("rank"), "n", "low", "high")
    ranks = staged(ranks, "ranks")
    open_ = (F.col("low") < F.col("high")) & (F.col("n") > few)
    while not ranks.where(open_).isEmpty():
        ranks = staged(_narrowed(values, ranks, on, open_, bins), "ranks")
    ends = _ranked(values, ranks, on)
    total = totals.select(*on, F.col("n").alias("total"))
    t, e = total.alias("t"), ends.alias("e")
    both = t.join(e, _same("t", "e", on), "left").groupBy(*[f"t.{k}" for k in on], "t.total").agg(*[
        F.max(F.when((F.col("e.name") == name) & (F.col("e.step") == step), F.col("e.value"))).alias(f"{name}_{step}")
        for name in probs for step in (0, 1)])
    at = lambda p: (F.col("total") - 1) * F.lit(float(p))
    between = {
        name: F.when(F.col(f"{name}_0") == F.col(f"{name}_1"), F.col(f"{name}_0")).otherwise(
            F.col(f"{name}_0") + (at(p) - F.floor(at(p))) * (F.col(f"{name}_1") - F.col(f"{name}_0")))
        for name, p in probs.items()}
    return both.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[c.alias(n) for n, c in between.items()])


def _within(values: DataFrame, ranges: DataFrame, on) -> DataFrame:
    """Values with the ranges that hold them; a short list of ranges is broadcast."""
    v, r = values.alias("v"), ranges.alias("r")
    return v.join(r, _same("v", "r", on) & F.col("v.value").between(F.col("r.low"), F.col("r.high"))).select(
        "v.*", "r.low", "r.high")


def _narrowed(values: DataFrame, ranks: DataFrame, on, open_: Column, bins: int) -> DataFrame:
    """Ranks within the bins that hold them."""
    ranges = staged(ranks.where(open_).select(*on, "low", "high").distinct(), "ranges")
    counts = _within(values, ranges, on).groupBy(*on, "low", "high", _bin(bins).alias("bin")).agg(
        F.count("*").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"))
    one = Window.partitionBy(*on, "low", "high").orderBy("bin")
    upto = F.sum("count").over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = staged(counts.withColumn("upto", upto), "bins")
    r, c = ranks.where(open_).alias("r"), counts.alias("c")
    same = _same("r", "c", [*on, "low", "high"])
    inside = (F.col("r.rank") < F.col("c.upto")) & (F.col("r.rank") >= F.col("c.upto") - F.col("c.count"))
    narrowed = r.join(c, same & inside).select(
        *[f"r.{k}" for k in on], "r.name", "r.step", (F.col("r.rank") - F.col("c.upto") + F.col("c.count")).alias("rank"),
        F.col("c.count").alias("n"), F.col("c.least").alias("low"), F.col("c.most").alias("high"))
    return narrowed.unionByName(ranks.where(~open_))


def _ranked(values: DataFrame, ranks: DataFrame, on) -> DataFrame:
    """(keys, name, step, value) of ranks whose ranges are single values or short."""
    single = ranks.where("low = high").select(*on, "name", "step", F.col("low").alias("value"))
    short = ranks.where("low < high")
    ranges = staged(short.select(*on, "low", "high").distinct(), "ranges")
    counts = _within(values, ranges, on).groupBy(*on, "low", "high", "value").agg(F.count("*").alias("count"))
    one = Window.partitionBy(*on, "low", "high").orderBy("value")
    upto = F.sum("count").over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c, r = counts.withColumn("upto", upto).alias("c"), short.alias("r")
    inside = (F.col("r.rank") < F.col("c.upto")) & (F.col("r.rank") >= F.col("c.upto") - F.col("c.count"))
    picked = r.join(c, _same("r", "c", [*on, "low", "high"]) & inside).select(
        *[f"r.{k}" for k in on], "r.name", "r.step", "c.value")
    return single.unionByName(picked)
