"""Weighted rendezvous sharding of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import fresh, numbered


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights) - 1 with the highest draw ``weight / -ln(u)``, u in (0, 1) hashed from key and shard.

    A shard's draw depends on nothing but the key and its own number and weight, so a new or heavier shard only takes rows,
    a removed one only gives its own away, and each holds its weight's share. Equal draws go to the larger number; weights
    of 0 take nothing while others are positive. A null key is a key like any other.
    """
    def draw(i: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("draw"), F.lit(i).alias("shard"))

    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights: one number of 0 or more per shard, at least one of them positive")
    return F.array_max(F.array(*[draw(i, w) for i, w in enumerate(weights)]))["shard"]


def shard(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with their shard in ``column``; no shuffle. An existing column of that name raises."""
    if fresh(df, column) != column:
        raise ValueError(f"{column} is already a column")
    return df.withColumn(column, rendezvous(F.col(key), weights))


def shard_slots(docs: DataFrame, weights: Sequence[float], added: Sequence[float] = (1.0,), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard.

    ``grown_shard`` is the shard after shards with the weights ``added`` join. Null texts have size 1 and the checksum of
    the empty text. Repeated rows get a slot each, in one shard. Other columns of ``docs`` are not read.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    rows = docs.select(
        key.alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, *added]).alias("grown_shard"))
    return numbered(rows, "shard", "slot")
