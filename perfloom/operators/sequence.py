"""Order-sensitive columns that stay parallel when one key owns most rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task.  ``KeyedSequence`` gives the same answers but cuts
keys of more than ``split_rows`` counted rows into order-preserving chunks: windows run per (key, chunk), one row per chunk
is carried over to the next chunk, and the carry comes back through a join on (key, chunk).  Chunk bounds come from a hash
sample of the hot keys only.  Where keys are cut, the rows go to the shared folder once per step, so no step repeats another;
``scan`` takes any number of folds in one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.shared import written

SPLIT_ROWS = 4_000_000          # rows one task may sort for one key
SAMPLE_PER_CHUNK = 256
FANOUT = 512

# Whether a plan has a hot key, by its semantic hash: only how rows are dealt depends on it, never which rows come out.
_hot_plans: dict[tuple, bool] = {}


def has_hot_key(df: DataFrame, keys: Sequence[str], rows: int) -> bool:
    """Whether some key has more than ``rows`` rows, by counting them (one job, counts are combined before the shuffle)."""
    mark = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), rows)
    if mark not in _hot_plans:
        if len(_hot_plans) > 4096:
            _hot_plans.clear()
        _hot_plans[mark] = not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(
            F.col("_rows") > rows).dropna(subset=list(keys)).isEmpty()
    return _hot_plans[mark]


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def _equal(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in pairs])


def _pick_chunk(bounds: Column, point: Column) -> Column:
    """Number of bounds <= point, by a two-level search."""
    coarse = F.filter(bounds, lambda b, i: i % FANOUT == FANOUT - 1)
    head = F.size(F.filter(coarse, lambda b: b <= point))
    tail = F.slice(bounds, head * FANOUT + 1, F.lit(FANOUT))
    return head * FANOUT + F.size(F.filter(tail, lambda b: b <= point))


_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.first(c, ignorenulls=True)}
_BACKWARDS = {**_RUNNING, "next": _RUNNING["last"]}
_TOTAL = {"sum": F.sum, "max": F.max, "count": F.count}


class KeyedSequence:
    """Rows of ``df`` grouped by ``keys`` in ascending ``order`` (names or columns; negate numbers for descending).

    Keys of more than ``split_rows`` rows are cut; 0 turns that off.  Rows with a null key are never split (the event model
    uses -1, not null), so all joins here are plain equi-joins.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 split_rows: int | None = None):
        self.keys = list(keys)
        self.columns = df.columns
        self._order = [o if isinstance(o, str) else f"_o{i}" for i, o in enumerate(order)]
        made = {f"_o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
        df = df.withColumns(made) if made else df
        if split_rows is None:
            split_rows = SPLIT_ROWS
        self.split = split_rows > 0 and has_hot_key(df, self.keys, split_rows)
        self.df = written(self._chunked(df, split_rows)) if self.split else df

    def _chunked(self, df: DataFrame, split_rows: int) -> DataFrame:
        point = F.struct(*self._order)
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_rows"))
        hot = counts.where(F.col("_rows") > split_rows).dropna(subset=self.keys).select(
            *[F.col(k).alias(f"_h_{k}") for k in self.keys], "_rows")
        on = [(k, f"_h_{k}") for k in self.keys]
        hot_keys = [f"_h_{k}" for k in self.keys]
        chunks = F.ceil(F.col("_rows") / split_rows)
        every = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_rows") / (chunks * SAMPLE_PER_CHUNK)))
        sampled = (
            df.select(*self.keys, *self._order)
            .join(hot, _equal(df, hot, on))
            .where(F.pmod(F.xxhash64(*self._order), every) == 0)
            .select(*hot_keys, chunks.alias("_c"), point.alias("_p"))
        )
        # Every size-th sampled row in order is a bound; how many there are decides nothing but the evenness of chunks.
        ranked = sampled.select(
            *hot_keys, "_p", F.row_number().over(Window.partitionBy(*hot_keys).orderBy("_p")).alias("_i"),
            F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*hot_keys)) / F.col("_c")).alias("_every"))
        bounds = ranked.where(F.col("_i") % F.col("_every") == 0).groupBy(*hot_keys).agg(F.sort_array(F.collect_list("_p")).alias("_bounds"))
        return (
            df.join(bounds, _equal(df, bounds, on), "left")
            .withColumn("_hot", F.col("_bounds").isNotNull())
            .withColumn("_chunk", F.when(F.col("_hot"), _pick_chunk(F.col("_bounds"), point)).otherwise(F.lit(0)))
            .drop("_bounds", *[f"_h_{k}" for k in self.keys])
        )

    def _window(self, keys: Sequence[str]) -> Window:
        return Window.partitionBy(*keys, *(["_chunk"] if self.split else [])).orderBy(*self._order)

    def _carry(self, keys: list[str], summary: Column, shifted) -> None:
        """Add ``_carry``: a value computed over the per-chunk summaries of the hot keys."""
        self.df = written(self.df)
        parts = self.df.where("_hot").groupBy(*keys, "_chunk").agg(summary.alias("_sum"))
        parts = parts.select(
            *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_chunk").alias("_p_chunk"),
            shifted(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
        )
        on = [(k, f"_p_{k}") for k in keys] + [("_chunk", "_p_chunk")]
        self.df = self.df.join(parts, _equal(self.df, parts, on), "left").drop(*[b for _, b in on])

    def shift(self, values: dict[str, str | Column], by: int = -1, within: Sequence[str] = ()) -> "KeyedSequence":
        """Columns of the previous (``by=-1``) or next (``by=1``) row; null at the end of a key."""
        keys = self.keys + list(within)
        near, w = (F.lag if by < 0 else F.lead), self._window(keys)
        if not self.split:
            self.df = self.df.withColumns({n: near(v).over(w) for n, v in values.items()})
        else:
            pack = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
            self.df = self.df.withColumn("_v", pack)
            self.df = self.df.withColumn("_near", near("_v").over(w))
            pick = F.max_by if by < 0 else F.min_by
            self._carry(keys, pick("_v", F.struct(*self._order)), lambda cw: near("_sum").over(cw))
            self.df = self.df.withColumn("_near", F.coalesce("_near", "_carry"))
            self.df = self.df.withColumns({n: F.col("_near")[n] for n in values}).drop("_v", "_near", "_carry")
        self.columns = self.columns + list(values)
        return self

    def scan(self, running: dict[str, tuple[str, str | Column]], total: dict[str, tuple[str, str | Column]] | None = None,
             within: Sequence[str] = ()) -> "KeyedSequence":
        """Several folds in one pass: one rewrite of the rows, one aggregate per chunk and one join, however many there are.

        ``running`` columns fold from the start of the key to the current row: ``sum``, ``min``, ``max``, ``last`` (last non-null),
        ``low`` (least running sum so far); ``next`` is the first non-null value from the current row on. ``total`` columns hold
        ``sum``, ``max`` or ``count`` over the whole key.
        """
        keys, total = self.keys + list(within), total or {}
        value = {n: F.col(v) if isinstance(v, str) else v for n, (_, v) in {**running, **total}.items()}
        how = {n: h for n, (h, _) in running.items()}
        held = {n: f"_v_{n}" for n in value} if self.split else {}
        if self.split:
            self.df = self.df.withColumns({held[n]: v for n, v in value.items()})
            value = {n: F.col(c) for n, c in held.items()}
        w = self._window(keys)
        up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # "next" is the last value met from the key's end: a frame that shrinks from the front is folded anew for each row
        down = w.orderBy(*[F.desc(o) for o in self._order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = {n: _BACKWARDS[h](value[n]).over(down if h == "next" else up) for n, h in how.items() if h != "low"}
        own |= {f"_at_{n}": F.sum(value[n]).over(up) for n, h in how.items() if h == "low"}
        whole = Window.partitionBy(*self.keys, *(["_chunk"] if self.split else []))
        own |= {n: _TOTAL[h](value[n]).over(whole) for n, (h, _) in total.items()}
        self.df = self.df.withColumns(own)
        if lows := {n: F.min(f"_at_{n}").over(up) for n, h in how.items() if h == "low"}:
            self.df = self.df.withColumns(lows)
        if self.split:
            self._add_carry(keys, how, {n: h for n, (h, _) in total.items()}, held)
        self.df = self.df.drop(*held.values(), *[f"_at_{n}" for n in how])
        self.columns = self.columns + list(running) + list(total)
        return self

    def _add_carry(self, keys: list[str], how: dict[str, str], total: dict[str, str], held: dict[str, str]) -> None:
        """Joins what the chunks before (or after) each chunk fold to, and adds it to the chunk's own columns."""
        self.df = written(self.df)
        place = F.struct(*self._order)
        states = {}
        for n, h in how.items():
            v = F.col(held[n])
            seen = F.when(v.isNotNull(), place)
            states |= {"last": {f"_s_{n}": F.max_by(v, seen)}, "next": {f"_s_{n}": F.min_by(v, seen)},
                       "low": {f"_s_{n}": F.sum(v), f"_m_{n}": F.min(f"_at_{n}")}}.get(h) or {f"_s_{n}": _RUNNING[h](v)}
        states |= {f"_t_{n}": _TOTAL[h](F.col(held[n])) for n, h in total.items()}
        parts = self.df.where("_hot").groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in states.items()])
        line = Window.partitionBy(*keys).orderBy("_chunk")
        before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
        every = Window.partitionBy(*keys)
        carry = {}
        for n, h in how.items():
            s = F.col(f"_s_{n}")
            carry[f"_c_{n}"] = F.sum(s).over(before) if h == "low" else _RUNNING[h](s).over(after if h == "next" else before)
        carry |= {f"_a_{n}": ((F.max if h == "max" else F.sum)(f"_t_{n}")).over(every) for n, h in total.items()}
        parts = parts.withColumns(carry)
        if lows := [n for n, h in how.items() if h == "low"]:
            zero = F.lit(0).cast("long")
            parts = parts.withColumns({f"_l_{n}": F.min(F.coalesce(f"_c_{n}", zero) + F.col(f"_m_{n}")).over(before) for n in lows})
        names = {k: f"_p_{k}" for k in keys} | {"_chunk": "_p_chunk"}
        parts = parts.select(*[F.col(k).alias(v) for k, v in names.items()], *carry, *[f"_l_{n}" for n in lows])
        out = self.df.join(parts, _equal(self.df, parts, list(names.items())), "left").drop(*names.values())
        joined = {}
        for n, h in how.items():
            c, own = F.col(f"_c_{n}"), F.col(n)
            if h == "sum":
                joined[n] = F.when(own.isNull(), c).otherwise(own + F.coalesce(c, F.lit(0)))
            elif h == "last" or h == "next":
                joined[n] = F.coalesce(own, c)
            elif h == "low":
                joined[n] = F.least(F.coalesce(c, F.lit(0).cast("long")) + own, f"_l_{n}")
            else:
                joined[n] = (F.least if h == "min" else F.greatest)(own, c)
        joined |= {n: F.when(F.col("_hot"), F.col(f"_a_{n}")).otherwise(F.col(n)) for n in total}
        self.df = out.withColumns(joined).drop(*carry, *[f"_l_{n}" for n in lows])

    def running(self, name: str, how: str, value: str | Column, within: Sequence[str] = ()) -> "KeyedSequence":
        """One running column; see ``scan``."""
        return self.scan({name: (how, value)}, within=within)

    def total(self, name: str, how: str, value: str | Column) -> "KeyedSequence":
        """``sum``, ``max`` or ``count`` over the whole key on every row."""
        return self.scan({}, {name: (how, value)})

    def rank(self, name: str = "rank", within: Sequence[str] = ()) -> "KeyedSequence":
        """1-based position inside the key."""
        return self.running(name, "sum", F.lit(1).cast("long"), within)

    def derive(self, **cols: Column) -> "KeyedSequence":
        self.df = self.df.withColumns(cols)
        self.columns = self.columns + [c for c in cols if c not in self.columns]
        return self

    def result(self) -> DataFrame:
        return self.df.select(*dict.fromkeys(self.columns))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark limits each map task to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], method: str = "linear",
                split_rows: int | None = None, stats: bool = False) -> DataFrame:
    """Exact percentiles per key from a value histogram, so no group is ever gathered in one buffer.

    ``linear`` interpolates at p*(n-1).  ``nearest`` takes sorted[int(n*p)], and the maximum while n is not above
    1/(1-p) (100 for p99, 1000 for p99.9); its p50 is sorted[n//2].  ``stats`` adds ``n``, ``mean`` and ``max`` from the
    same histogram.
    """
    hist = value_counts(df, keys, value)
    ranked = (KeyedSequence(hist, keys, [value], split_rows).scan({"_hi": ("sum", "_freq")}, {"_n": ("sum", "_freq"), "_max": ("max", value)}).result())

    def at(pos: Column) -> Column:      # value at 0-based position
        return F.max(F.when((F.col("_hi") - F.col("_freq") <= pos) & (pos < F.col("_hi")), F.col(value)))

    aggs = []
    if stats:
        mean = F.sum(F.col(value) * F.col("_freq")).cast("double") / F.sum("_freq")
        aggs = [F.sum("_freq").alias("n"), mean.alias("mean"), F.max(value).alias("max")]
    for name, p in points.items():
        if method == "linear":
            pos = (F.col("_n") - 1).cast("double") * F.lit(p)
            low, high = at(F.floor(pos)), at(F.ceil(pos))
            frac = F.max(pos - F.floor(pos))
            aggs.append((low + (high - low) * frac).cast("double").alias(name))
        else:
            pos = F.floor(F.col("_n") * F.lit(p)) if p != 0.5 else F.expr("_n div 2")
            pick = at(pos)
            if p > 0.5:
                pick = F.when(F.max("_n") > round(1 / (1 - p)), pick).otherwise(F.max("_max"))
            aggs.append(pick.alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
