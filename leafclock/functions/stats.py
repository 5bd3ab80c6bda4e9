"""Exact statistics that combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Years held by one bit set word.
WORD = 63


def quantiles(value: str, probs, weight: Column | None = None) -> Column:
    """Linear-interpolation (type 7) quantiles, optionally weighted by a count.

    The buffer maps each value to its count: at most 366 entries for days of year.
    """
    probs = [F.lit(float(q)) for q in probs]
    args = (F.col(value), F.array(*probs))
    return F.percentile(*args) if weight is None else F.percentile(*args, weight)


def year_words(years: range) -> list[str]:
    return [f"years_{i}" for i in range(-(-max(1, len(years)) // WORD))]


def year_bits(year: Column, years: range) -> list[Column]:
    """A year as one bit, spread over as many long words as the span needs."""
    offset = year - years.start
    return [
        F.when(
            (offset >= i * WORD) & (offset < (i + 1) * WORD),
            F.call_function("shiftleft", F.lit(1).cast("long"), (offset - i * WORD).cast("int")),
        )
        .otherwise(F.lit(0).cast("long"))
        .alias(name)
        for i, name in enumerate(year_words(years))
    ]


def or_years(years: range) -> list[Column]:
    return [F.bit_or(w).alias(w) for w in year_words(years)]


def count_years(years: range) -> Column:
    words = [F.bit_count(w).cast("long") for w in year_words(years)]
    return sum(words[1:], words[0])


def n_distinct(column: str) -> Column:
    """Distinct values where a missing value counts as one more."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def count_quantiles(
    df: DataFrame, keys, value: str, weight: str, probs: dict, extra=()
) -> DataFrame:
    """Type 7 quantiles per group of values that carry a count.

    Needs one row per group and value (days of year: at most 366 per group), which
    running sums then rank. Everything stays in generated code; the percentile
    aggregate would build and ship an object map per group and task. ``extra`` are
    further aggregates.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns(
        {"q_upto": F.sum(weight).over(upto), "q_total": F.sum(weight).over(group)}
    )

    def at(prob):
        return (F.col("q_total") - 1) * F.lit(float(prob))

    picks = []
    for name, prob in probs.items():
        low = F.floor(at(prob))
        picks.append(F.min(F.when(F.col("q_upto") > low, F.col(value))).alias(f"{name}_low"))
        picks.append(F.min(F.when(F.col("q_upto") > low + 1, F.col(value))).alias(f"{name}_high"))
    out = ranked.groupBy(*keys).agg(F.max("q_total").alias("q_total"), *picks, *extra)

    def between(name, prob):
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        share = at(prob) - F.floor(at(prob))
        return low + share * (F.coalesce(high, low) - low)

    out = out.withColumns({name: between(name, prob) for name, prob in probs.items()})
    return out.drop("q_total", *[f"{n}_{e}" for n in probs for e in ("low", "high")])
