"""Row-level labels, dates and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafclock.params import FUNC_TYPE_CODES


def text(column) -> Column:
    """Value as text, a missing one as ``NA``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("NA"))


def joined(*columns, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[text(c) for c in columns])


def indiv(unit: str = "id") -> Column:
    return joined("common_name", unit)


def panel(label: Column, state="state") -> Column:
    return F.concat(label, F.lit(" ("), text(state), F.lit(")"))


def sentence_case(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.upper(F.left(column, F.lit(1))), F.lower(F.substring(column, 2, 1 << 30)))


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").when(~condition, "No")


def eo_label() -> Column:
    return F.when(F.col("outlier") == 1, "Outlier").when(F.col("early") == 1, "Early")


def eo_rank() -> Column:
    """Order of the labels: early before outlier."""
    return F.when(F.col("outlier") == 1, 2).when(F.col("early") == 1, 1)


def func_type_code(column: str = "func_type", codes=FUNC_TYPE_CODES) -> Column:
    out = F.lit(None).cast("string")
    for name, code in codes.items():
        out = F.when(F.col(column) == name, code).otherwise(out)
    return out


def doy_to_date(year, doy) -> Column:
    year = F.col(year) if isinstance(year, str) else year
    doy = F.col(doy) if isinstance(doy, str) else doy
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def month_day(year, doy) -> Column:
    return F.date_format(doy_to_date(year, doy), "MM-dd")


def day_of(year: int, mmdd: str) -> Column:
    """Day of year of a month-day in a given year."""
    return F.dayofyear(F.to_date(F.lit(f"{year}-{mmdd}")))
