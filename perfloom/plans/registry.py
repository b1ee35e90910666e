"""Registry of runnable queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfloom.plans.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views, sql, recursive) if views else sql
        return fn

    return keep


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Counts as long and doubles rounded, so results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, places)
        cols.append(c.alias(f.name))
    return df.select(*cols)
