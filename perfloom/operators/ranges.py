"""Time spans and points matched by equi-joins on cells of a grid whose size fits the span.

A pure range predicate would plan as a nested loop, and listing a span under every small bucket it touches makes rows with its
length.  Here each span is listed once, under the cell of its start in a grid at least as wide as the span: a point inside it lies
in that cell or the next, so a point looks at two cells per grid width, whatever the spans.  The other way round, a long span that
asks for points inside it is covered by few cells, wide ones in its middle and narrow ones at its ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIRST, _STEP, _WIDTHS = 10, 2, 14      # grids of 2 ** 10, 2 ** 12, ... 2 ** 36 us; one more without cells for longer spans
_FAN, _FLOORS = 6, 5                    # 2 ** 6 cells are one of the next floor


def _cell(at: str, level: str) -> Column:
    return F.expr(f"shiftright({at}, {_FIRST} + {_STEP} * {level})")


def listed_spans(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """``spans`` with ``_level, _cell``: one row each."""
    length = F.col(hi) - F.col(lo)
    level = sum(((length > (1 << (_FIRST + _STEP * k))).cast("int") for k in range(1, _WIDTHS)), (length > (1 << _FIRST)).cast("int"))
    return spans.withColumn("_level", level).withColumn(
        "_cell", F.when(F.col("_level") < _WIDTHS, _cell(f"`{lo}`", "_level")).otherwise(F.lit(0).cast("long")))


def probing_points(points: DataFrame, at: str) -> DataFrame:
    """``points`` under the cells in which a span around ``at`` can be listed: two per width."""
    cells = [F.struct(F.lit(k).alias("_level"), (_cell(f"`{at}`", str(k)) - back).alias("_cell")) for k in range(_WIDTHS) for back in (0, 1)]
    return points.select("*", F.inline(F.array(*cells, F.struct(F.lit(_WIDTHS).alias("_level"), F.lit(0).cast("long").alias("_cell")))))


def spans_around(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Inner join of points with the spans of their keys that hold them: ``lo <= at <= hi``; other names must differ."""
    both = probing_points(points, at).join(listed_spans(spans, lo, hi), [*keys, "_level", "_cell"])
    return both.where((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi))).drop("_level", "_cell")


def _run(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _on_floor(f: int):
    return lambda number: F.struct(F.lit(f).alias("_floor"), number.alias("_node"))


def covering_cells(df: DataFrame, first: str, last: str) -> DataFrame:
    """``df`` once per cell (``_floor``, ``_node``) of a cover of the base cells ``first`` to ``last``, without overlap.

    A cell of floor f is 64 ** f base cells; at most 126 cells of a floor are needed, the last floor apart.
    """
    def ends(f: int) -> tuple[Column, Column]:      # whole cells of floor f inside
        if not f:
            return F.col(first), F.col(last)
        return F.expr(f"-shiftright(-`{first}`, {_FAN * f})"), F.expr(f"shiftright(`{last}` + 1, {_FAN * f}) - 1")

    floors = []
    for f in range(_FLOORS):
        lo, hi = ends(f)
        cells = _run(lo, hi)
        if f + 1 < _FLOORS:
            up_lo, up_hi = ends(f + 1)
            wide = F.lit(1 << _FAN).cast("long")
            cells = F.when(up_lo > up_hi, cells).otherwise(F.concat(_run(lo, up_lo * wide - 1), _run((up_hi + 1) * wide, hi)))
        floors.append(F.transform(cells, _on_floor(f)))
    return df.select("*", F.inline(F.concat(*floors)))


def upper_cells(df: DataFrame, base: str) -> DataFrame:
    """``df`` once per floor above the base cells, under the cell that holds base cell ``base``."""
    nodes = [F.struct(F.lit(f).alias("_floor"), F.expr(f"shiftright(`{base}`, {_FAN * f})").alias("_node")) for f in range(1, _FLOORS)]
    return df.select("*", F.inline(F.array(*nodes)))
