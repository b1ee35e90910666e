"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from perfloom.shared import ship, written

__all__ = ["ascii_lower", "fresh", "id_remainder", "numbered", "ship", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_remainder(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def numbered(df: DataFrame, by: str, number: str, cells: int = 4096) -> DataFrame:
    """Numbers the rows of each value of ``by`` from 0 without gaps, in an order that the rows' own values fix.

    Rows are dealt to ``cells`` cells per value by a hash of all their columns, counted per cell, and numbered cell by cell
    in parallel from the running total of the cells before. Equal rows are counted first and repeated last, so neither a
    large group nor many equal rows meet in one task. The table of totals has ``cells`` rows per value of ``by``.
    """
    cols = list(df.columns)
    cell, n, first = (fresh(df, x) for x in ("cell", "n", "first"))
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)).withColumn(cell, F.pmod(F.xxhash64(*cols), F.lit(cells)).cast("int"))
    order = W.partitionBy(by).orderBy(cell)
    totals = groups.groupBy(by, cell).agg(F.sum(n).alias(first)).withColumn(first, F.sum(first).over(order) - F.col(first))
    inner = W.partitionBy(by, cell).orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    within = groups.withColumn(number, F.sum(n).over(inner) - F.col(n))
    joined = within.join(totals.withColumnsRenamed({by: by + "_", cell: cell + "_"}),
                         F.col(by).eqNullSafe(F.col(by + "_")) & (F.col(cell) == F.col(cell + "_")))
    start = F.col(number) + F.col(first)
    return joined.select(*cols, F.explode(F.sequence(start, start + F.col(n) - 1)).alias(number))
