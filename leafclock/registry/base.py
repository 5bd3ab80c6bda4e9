"""Registration helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLE: dict = {}


def rounded_columns(df: DataFrame, places: int = 6) -> dict[str, Column]:
    """Doubles of ``df`` to a fixed number of places, dates as text, so engines agree."""
    out = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            # Adding zero turns -0.0 into 0.0.
            out[field.name] = F.round(c, places) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            out[field.name] = c.cast("string")
    return out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with its ``rounded_columns``."""
    out = rounded_columns(df, places)
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def query(name: str, sql: str | None = None, rounds: bool = True):
    """Register a query. Without ``rounds`` it returns ``rounded_columns`` already."""

    def register(fn):
        def run(spark, sf_dir):
            out = fn(spark, sf_dir)
            return rounded(out) if rounds else out

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
