"""Nearest-value and ceiling look-ups against a table of sizes, merged by order instead of compared pairwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.operators.sequence import KeyedSequence


def _merged(wanted: DataFrame, table: DataFrame, keys: Sequence[str], want: str, size: str, payload: str,
            tie: str) -> DataFrame:
    ask = wanted.select(*keys, F.col(want).alias("_x"), F.struct(*wanted.columns).alias("_ask"),
                        F.lit(None).cast(table.schema[payload].dataType).alias("_pay"), F.lit(None).cast("long").alias("_t"))
    have = table.groupBy(*keys, F.col(size).alias("_x")).agg(F.min_by(payload, tie).alias("_pay"), F.min(tie).alias("_t"))
    have = have.select(*keys, "_x", F.lit(None).cast(ask.schema["_ask"].dataType).alias("_ask"), "_pay", F.col("_t").cast("long"))
    both = ask.unionByName(have)
    return both.withColumn("_hit", F.when(F.col("_ask").isNull(), F.struct("_x", "_t", "_pay")))


def nearest(wanted: DataFrame, table: DataFrame, keys: Sequence[str], want: str, size: str, payload: str, tie: str,
            split_rows: int | None = None) -> DataFrame:
    """For each wanted row the table row whose size is closest; on equal distance the one with the lower ``tie``."""
    both = _merged(wanted, table, keys, want, size, payload, tie)
    side = F.col("_ask").isNotNull().cast("int")
    spread = F.xxhash64("_ask")
    # table rows come before wanted rows of their size, so an equal size is met from below
    up = KeyedSequence(both, keys, [F.col("_x"), side, spread], split_rows).scan({"_below": ("last", "_hit"), "_above": ("next", "_hit")}).result()
    lo = F.when(F.col("_below").isNotNull(), F.struct(
        (F.col("_x") - F.col("_below._x")).alias("d"), F.col("_below._t").alias("t"), F.col("_below._pay").alias("p"),
        F.col("_below._x").alias("s")))
    hi = F.when(F.col("_above").isNotNull(), F.struct(
        (F.col("_above._x") - F.col("_x")).alias("d"), F.col("_above._t").alias("t"), F.col("_above._pay").alias("p"),
        F.col("_above._x").alias("s")))
    best = F.least(lo, hi)
    return up.where("_ask is not null").withColumn("_b", best).select(
        "_ask.*", F.col("_b.s").alias("matched_size"), F.col("_b.p").alias(payload))


def ceiling(wanted: DataFrame, table: DataFrame, keys: Sequence[str], want: str, size: str, payload: str, tie: str,
            split_rows: int | None = None) -> DataFrame:
    """First bucket whose bound is not below the wanted size, else the last bucket of the key."""
    both = _merged(wanted, table, keys, want, size, payload, tie)
    side = F.col("_ask").isNotNull().cast("int")
    up = KeyedSequence(both, keys, [-F.col("_x"), side, F.xxhash64("_ask")], split_rows).running("_above", "last", "_hit").result()
    last = table.groupBy(*keys).agg(F.max(F.struct(F.col(size).alias("_x"), (-F.col(tie)).alias("_t"), F.col(payload).alias("_p"))).alias("_last"))
    out = up.where("_ask is not null").join(last, list(keys), "left")
    return out.select("_ask.*", F.coalesce("_above._x", "_last._x").alias("matched_size"),
                      F.coalesce("_above._pay", "_last._p").alias(payload))
