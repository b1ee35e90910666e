"""Structured Streaming versions of the windowed and ordered operators.

Sources here have integer microsecond ``ts``; ``with_event_time`` adds the timestamp and the watermark.  Rows later than
the watermark are dropped, rows out of order inside it give the batch result; ``split_late`` keeps them in a table of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from perfloom.operators.events import K
from perfloom.operators.timeline import _summary_aggs, device_kernels
from perfloom.shared import shared_dir as new_folder
from perfloom.shared import ship
from perfloom.sources.files import _LOW33, file_id


def shared_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A fresh folder under the cluster's checkpoint directory; ``fallback`` only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir or pass a shared folder")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources

def tail_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def closed(stream: DataFrame, rows: DataFrame, kind: str, ts: str = "ts", after: str = "30 days") -> DataFrame:
    """A bounded ``stream`` of ``rows`` that ends: one more row of each ``kind``, ``after`` the last time stamp.

    The watermark passes all real rows with them, so windows close and waiting rows are released; the closing rows themselves
    stay above the watermark and come out of nothing.  Choose ``after`` longer than delay and windows.
    """
    last = rows.agg(F.max(ts)).first()[0]
    if last is None:
        return stream
    ends = rows.groupBy(kind).agg(F.max_by(F.struct(*rows.columns), ts).alias("r")).select("r.*").withColumn(
        ts, F.lit(last) + F.expr(f"INTERVAL {after}"))
    path = new_folder(rows.sparkSession)
    ends.select(*rows.columns).write.parquet(path)
    return stream.unionByName(tail_parquet(rows.sparkSession, path, rows.schema))


def tail_lines(spark: SparkSession, path: str, id_col: str = "log_id") -> DataFrame:
    """Lines of files as they arrive: ``id_col, seq, value``; ``seq`` is the split's byte offset plus the row in it, so it
    follows the order of lines in a file."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))
    return spark.readStream.text(path).select(
        file_id(F.col("_metadata.file_path")).alias(id_col), (F.col("_metadata.file_block_start") + row).alias("seq"), "value")


def with_event_time(stream: DataFrame, delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros(ts)).withWatermark("event_time", delay)


# ---------------------------------------------------------------- windows

def _interval(us: int) -> str:
    return f"{us} microseconds"


def tumbling_summary(stream: DataFrame, K: Sequence[str] = K, window_us: int = 100_000) -> DataFrame:
    w = F.window("event_time", _interval(window_us))
    return stream.groupBy(*K, w.alias("_w")).agg(*_summary_aggs()).withColumn(
        "window_start", F.unix_micros("_w.start")).drop("_w")


def sliding_util(stream: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000, slide_us: int = 500_000) -> DataFrame:
    w = F.window("event_time", _interval(window_us), _interval(slide_us))
    return stream.where("dur > 0 and cpu >= 0").groupBy(*K, "cpu", w.alias("_w")).agg(
        (F.sum("dur") / F.lit(float(window_us)) * 100).alias("util_pct")).withColumn(
        "window_start", F.unix_micros("_w.start")).drop("_w")


# ---------------------------------------------------------------- ordered state

Step = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Rows of a bucket of keys wait in a list, one entry each, until the watermark has passed them; then ``step`` takes them in order.

    The lists ``carry`` and ``seen`` have one entry for each key, in the same order. Timers are kept by the engine: one for the rows
    that wait, one for the time at which the next key counts as idle.
    """

    def __init__(self, keys: list[str], values: T.StructType, carry: T.StructType, names: list[str], step: Step, order: list[str], idle_us: int | None):
        self.keys, self.values, self.carry_type, self.names, self.step, self.order, self.idle_us = keys, values, carry, names, step, order, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.values)
        self.carry = handle.getListState("carry", self.carry_type)
        self.seen = handle.getListState("seen", T.StructType([T.StructField("ts", T.LongType())]))

    def _rows(self, frame: pd.DataFrame) -> list[tuple]:
        return list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))

    def _keep(self, state, frame: pd.DataFrame) -> None:
        if len(frame):
            state.put(self._rows(frame))
        else:
            state.clear()

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(int(ts) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.values.fieldNames()
        new = pd.concat([r[names] for r in rows])
        self.waiting.appendList(self._rows(new))
        self._wake(new["ts"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.values.fieldNames())
        carry = pd.DataFrame(list(self.carry.get()), columns=self.carry_type.fieldNames())
        carry["_seen"] = [t for t, in self.seen.get()]
        due, out = rows["ts"] < mark, None
        if due.any():
            out, carry = self._stepped(rows[due].sort_values(self.order, kind="stable"), carry)
            self._keep(self.waiting, rest := rows[~due])
            if len(rest):
                self._wake(rest["ts"].min())
        if self.idle_us is not None:
            idle = carry["_seen"] + self.idle_us < mark
            if out is None and not idle.any():
                return
            carry = carry[~idle]
            if len(carry):
                self._wake(carry["_seen"].min() + self.idle_us)
        elif out is None:
            return
        self._keep(self.carry, carry[self.carry_type.fieldNames()])
        self._keep(self.seen, carry[["_seen"]])
        if out is not None and len(out):
            yield out[self.names]

    def _stepped(self, rows: pd.DataFrame, carry: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What ``step`` makes of the rows, and the carry of all keys after them."""
        both = pd.concat([carry[self.keys], rows[self.keys]]) if len(carry) else rows[self.keys]
        number = both.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        held, own = number[: len(carry)], number[len(carry) :]
        place = np.argsort(own, kind="stable")
        rows, own = rows.iloc[place].reset_index(drop=True), own[place]
        first, last = np.r_[True, own[1:] != own[:-1]], np.r_[own[1:] != own[:-1], True]
        at = np.full(number.max() + 1, -1)
        at[held] = np.arange(len(carry))
        known, anew = at[own] >= 0, np.zeros(len(own), dtype=bool)
        if self.idle_us is not None:  # a key begins anew where it was idle
            ts = rows["ts"].to_numpy()
            before = np.r_[ts[:1], ts[:-1]]
            before[first & known] = carry["_seen"].to_numpy()[at[own[first & known]]]
            anew = (ts - before > self.idle_us) & (known | ~first)
        run = np.cumsum(first | anew) - 1
        goes_on = first & known & ~anew
        begin = carry.iloc[at[own[goes_on]]].drop(columns=[*self.keys, "_seen"]).set_axis(run[goes_on])
        out, after = self.step(rows, run, begin)
        out[self.keys] = rows.loc[out.index, self.keys]
        ends = rows.loc[last, self.keys].reset_index(drop=True)
        ends = pd.concat([ends, after.loc[run[last]].reset_index(drop=True), rows.loc[last, ["ts"]].reset_index(drop=True)], axis=1)
        ends.columns = carry.columns
        stay = carry[~np.isin(held, own)]
        return out, pd.concat([stay, ends], ignore_index=True) if len(stay) else ends

    def close(self) -> None:
        pass


def ordered_apply(stream: DataFrame, keys: Sequence[str], values: Sequence[str], carry_ddl: str, step: Step, out_ddl: str,
                  order: Sequence[str] = ("ts", "seq"), idle_us: int | None = None, buckets: int = 1024) -> DataFrame:
    """Run ``step(rows, run, carry)`` over rows of each key in ``order``, once the watermark has passed them.

    Rows above the watermark wait in the state, so arrival order inside the delay does not matter; an event-time timer
    releases them when no further row of the key arrives.  A step takes the rows of many keys at once, those of a key together:
    ``run`` numbers the stretch of each row, and ``carry`` has a row of ``carry_ddl`` for each run that goes on from one before,
    by its number. It returns rows with the index of theirs, and the carry of each run, by its number.  With ``idle_us`` a
    key leaves the state once the watermark is that far past its last row, and a row so much later than the one before starts anew,
    whenever it comes.  The state is kept for ``buckets`` of keys, so its calls don't grow with the keys; the number must stay the
    same over restarts.  Needs the state store on disk, which is set for the session here.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keys, values = list(keys), list(values)
    key_fields = [stream.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + T._parse_datatype_string(out_ddl).fields)
    processor = _Ordered(keys, T.StructType(key_fields + [stream.schema[v] for v in values]),
                         T.StructType(key_fields + T._parse_datatype_string(carry_ddl).fields), out_schema.fieldNames(), step, list(order), idle_us)
    # keys with the same columns null share a bucket, so no number is made a float beside a null
    nulls = sum((F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) + buckets * nulls
    slim = stream.select(bucket.alias("_bucket"), *keys, *values, "event_time")
    return slim.groupBy("_bucket").transformWithStateInPandas(processor, out_schema, "append", "eventtime")


def _last(values: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
    """The last of ``values`` of each run, by its number."""
    at = np.r_[run[1:] != run[:-1], True]
    return values[at].set_axis(run[at])


def _before(values: pd.DataFrame, run: np.ndarray, carry: pd.DataFrame) -> pd.DataFrame:
    """``values`` of the row before in the run; of the first row those of ``carry``, null where there is none."""
    out, first = values.groupby(run).shift(), np.r_[True, run[1:] != run[:-1]]
    begin = carry.astype(values.dtypes.to_dict()).reindex(run[first])
    for c in values.columns:
        out.loc[first, c] = begin[c].array
    return out


def gap_scan(stream: DataFrame, K: Sequence[str] = K, min_gap_us: int = 100, idle_us: int | None = None) -> DataFrame:
    """Idle gaps per (trace, device, stream); the state is the end and name of the last kernel."""

    def step(rows, run, carry):
        ends = pd.DataFrame({"end_ts": (rows["ts"] + rows["dur"]).astype("Int64"), "name": rows["name"].astype(object)})
        before = _before(ends, run, carry)
        out = pd.DataFrame({"gap_start": before["end_ts"], "gap_end": rows["ts"], "prev_kernel": before["name"], "next_kernel": rows["name"]})
        out = out[out["gap_start"].notna()].astype({"gap_start": "int64"})
        out["gap_dur"] = out["gap_end"] - out["gap_start"]
        return out[(out["gap_dur"] > 0) & (out["gap_dur"] >= min_gap_us)].copy(), _last(ends, run)

    return ordered_apply(device_kernels(stream), [*K, "device_id", "stream_id"], ["ts", "seq", "dur", "name"], "end_ts bigint, name string", step,
                         "gap_start bigint, gap_end bigint, gap_dur bigint, prev_kernel string, next_kernel string", idle_us=idle_us)


def sched_latency(stream: DataFrame, K: Sequence[str] = K, idle_us: int | None = None) -> DataFrame:
    """Wakeup to next switch-in per pid; the state is the last mark of the pid."""
    name = F.lower("name")
    is_switch = name.contains("switch")
    marks = stream.where((F.col("cat") == "cpu_sched") & (is_switch | name.contains("wakeup"))).select(
        *K, F.when(is_switch, F.col("next_pid")).otherwise(F.col("wake_pid")).alias("pid"), "ts", "seq",
        (~is_switch).alias("is_start"), "event_time").where("pid >= 0")

    def step(rows, run, carry):
        own = pd.DataFrame({"mark_ts": rows["ts"].astype("Int64"), "is_start": rows["is_start"].astype("boolean")})
        before = _before(own, run, carry)
        hit = (~own["is_start"] & before["is_start"].fillna(False)).astype(bool)
        out = pd.DataFrame({"wake_ts": before["mark_ts"][hit].astype("int64"), "switch_ts": rows["ts"][hit]})
        out["latency_us"] = out["switch_ts"] - out["wake_ts"]
        return out, _last(own, run)

    return ordered_apply(marks, [*K, "pid"], ["ts", "seq", "is_start"], "mark_ts bigint, is_start boolean", step,
                         "wake_ts bigint, switch_ts bigint, latency_us bigint", idle_us=idle_us)


# ---------------------------------------------------------------- sinks

def write_table(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
                available_now: bool = False) -> StreamingQuery:
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def split_key_events(stream: DataFrame, key: Column, all_path: str, key_path: str, checkpoint: str,
                     available_now: bool = False) -> StreamingQuery:
    """Every row to one table, key events also to another.

    Each micro-batch owns one partition folder and overwrites it, so a batch run again after a failure leaves no copies.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        tagged = batch.withColumn("_key", F.coalesce(key, F.lit(False)))
        tagged.drop("_key").write.mode("overwrite").parquet(f"{all_path}/batch={epoch}")
        tagged.where("_key").drop("_key").write.mode("overwrite").parquet(f"{key_path}/batch={epoch}")

    w = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def split_late(stream: DataFrame, delay_us: int, on_time_path: str, late_path: str, marks_path: str, checkpoint: str, ts: str = "ts",
               available_now: bool = False) -> StreamingQuery:
    """Rows below the watermark to a side table, all others to the main one, which later streams read without losing any.

    The watermark of a batch is the greatest time of the batches before it less ``delay_us``, as the engine's own, and is kept beside
    the tables. Each micro-batch owns one partition folder of each and overwrites it, so a batch run again leaves no copies; the
    side table's ``batch`` column tells how many rows each batch had too late. Rows without time are on time.
    """
    spark = stream.sparkSession

    def mark_of(epoch: int) -> int | None:
        """One number: the watermark after a batch."""
        return spark.read.schema("mark long").parquet(f"{marks_path}/batch={epoch}").first()["mark"] if epoch >= 0 else None

    def save(batch: DataFrame, epoch: int) -> None:
        mark = mark_of(epoch - 1)
        late = F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{on_time_path}/batch={epoch}")
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={epoch}")
        batch.agg(F.greatest(F.max(ts) - delay_us, F.lit(mark).cast("long")).alias("mark")).write.mode("overwrite").parquet(f"{marks_path}/batch={epoch}")

    w = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def drain(stream: DataFrame, name: str, fallback: str | None = None) -> DataFrame:
    """Run a stream over the files present now and read back what it wrote."""
    spark = stream.sparkSession
    root = shared_dir(spark, name, fallback)
    write_table(stream, f"{root}/out", f"{root}/ck", available_now=True).awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(f"{root}/out")
