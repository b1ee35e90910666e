"""Importance resampling towards a target distribution, with the lines of the texts as the unit that is counted once.

Features are hashed runs of one to three words. A line feed separates words, so a text's features are those inside its lines and
those that cross a line's end. Lines are grouped over the whole corpus: the features of each distinct line are computed once and
count as often as the line occurs; the few that cross lines are computed per text and added. The same split gives a text's weight:
the gains of its distinct lines, looked up, and those of its crossing features.

Lines that make up at least 1 / ``FREQUENT`` of all lines, of which there can be no more than ``FREQUENT``, are looked up by
broadcast; every other line is too rare to weigh on one task of the join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from perfloom.llm.common import ship, written
from perfloom.shared import shared_dir

BUCKETS = 10_000
LONGEST = 3         # words of a feature
FREQUENT = 5_000
# ASCII: letters and digits stay, in lower case, all else separates words; bytes of other characters stay.
_KEPT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def feature_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of all runs of one to three words: unsigned crc32 of the words joined by one space, modulo ``BUCKETS``."""
    crc, spaced = zlib.crc32, [b" " + w for w in words]
    sums = [crc(w) for w in words]
    out = list(sums)
    for k in range(1, LONGEST):
        sums = list(map(crc, spaced[k:], sums))  # the run one word longer
        out += sums
    return (np.array(out, dtype=np.uint32) % BUCKETS).astype("<u2")


def crossing_buckets(lines: list[list[bytes]]) -> np.ndarray:
    """Buckets of the runs that begin in one line and end in another; ``lines`` have words."""
    crc, out = zlib.crc32, []
    # Only the first and last words of a line can take part; a line of few words may be passed through whole.
    before: list[tuple[int, bytes]] = []
    for n, line in enumerate(lines):
        reach = before + [(n, w) for w in line[: LONGEST - 1]]
        for end in range(len(before), len(reach)):
            for first in range(max(0, end - LONGEST + 1), end):
                if reach[first][0] != n:
                    out.append(crc(b" ".join(w for _, w in reach[first : end + 1])))
        before = (before + [(n, w) for w in line])[-(LONGEST - 1) :]
    return (np.array(out, dtype=np.uint32) % BUCKETS).astype("<u2")


def _key(line: bytes) -> tuple[int, int]:
    """128 bits that name a line."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(line), dtype="<i8").tolist())


def _texts(df: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per distinct line with words: its key (a, b), ``times`` it occurs, and the ``buckets`` of its features (two bytes each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for line, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = line.encode("utf-8", "surrogatepass")
                words = words_of(raw)
                if words:
                    got.append((*_key(raw), times, feature_buckets(words).tobytes()))
            columns = list(zip(*got)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["a", "b", "times", "buckets"])

    ship(docs.sparkSession)
    each = docs.select(F.explode(F.split(_texts(docs, text_col), "\n", -1)).alias("line")).where("line <> ''")
    return each.groupBy("line").agg(F.count(F.lit(1)).alias("times")).mapInArrow(run, "a long, b long, times long, buckets binary")


def texts_by_line(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``row`` (its number), id, ``n_words``, the distinct ``lines`` (key and times) and the ``buckets`` that cross lines."""
    line_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, listed, crossing = [], [], []
            for t in b.column("text").to_pylist():
                own: dict[bytes, int] = {}
                split = []
                for line in t.encode("utf-8", "surrogatepass").split(b"\n"):
                    words = words_of(line)
                    if words:
                        own[line] = own.get(line, 0) + 1
                        split.append(words)
                counts.append(sum(map(len, split)))
                listed.append([dict(zip("ab", _key(line)), times=n) for line, n in own.items()])
                crossing.append(crossing_buckets(split).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), pa.array(counts, pa.int64()), pa.array(listed, line_type), pa.array(crossing, pa.binary())],
                ["row", "id", "n_words", "lines", "buckets"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _texts(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n_words long, lines array<struct<a: long, b: long, times: long>>, buckets binary")


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, packed harder than others: buckets are most of what this operator keeps."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counts(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, n): how often the features of each bucket occur, from ``lines`` and ``texts_by_line``; one vector a task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            found = [np.frombuffer(x, dtype="<u2") for x in b.column(0).to_pylist()]
            if found:
                times = np.repeat(b.column(1).to_numpy(), [len(x) for x in found])
                np.add.at(total, np.concatenate(found), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    both = distinct.select("buckets", "times").union(texts.select("buckets", F.lit(1).cast("long")))
    return both.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket, from the (bucket, n) of both: a table of ``BUCKETS`` numbers, whatever the input."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r.bucket], t[r.bucket] = r.s, r.t
    ratio = (t + 1.0) * (s.sum() + BUCKETS) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def _with_gain(df: DataFrame, gain: np.ndarray, kept: list[str]) -> DataFrame:
    """``kept`` columns, ``n`` (features) and ``gain`` (their sum) of the rows' ``buckets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, dtype="<u2") for x in b.column("buckets").to_pylist()]
            n, total = [len(x) for x in found], [int(gain[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(total, pa.int64())], [*kept, "n", "gain"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, "buckets").mapInArrow(run, f"{kinds}, n long, gain long")


def weights(distinct: DataFrame, texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row of ``texts``: row, id, n_words, ``n_features`` and ``weight``, the sum of the gains of its features."""
    total = distinct.agg(F.sum("times")).first()[0] or 0
    known = _with_gain(distinct, gain, ["a", "b", "times"]).withColumnsRenamed({"times": "all_times", "a": "line_a", "b": "line_b"})
    often = F.col("all_times") * FREQUENT >= total
    asked = texts.select("row", F.explode("lines").alias("l")).select("row", "l.a", "l.b", "l.times")
    on = (F.col("a") == F.col("line_a")) & (F.col("b") == F.col("line_b"))
    frequent = F.broadcast(known.where(often).select("line_a", "line_b", F.col("n").alias("n_"), F.col("gain").alias("gain_")))
    met = asked.join(frequent, on, "left")
    sums = [(F.col("times") * F.col(c)).alias(c) for c in ("n", "gain")]
    rare = met.where("line_a is null").drop("line_a", "line_b", "n_", "gain_").join(known.where(~often), on)
    found = rare.select("row", *sums).union(met.where("line_a is not null").select("row", F.col("times") * F.col("n_"), F.col("times") * F.col("gain_")))
    crossing = _with_gain(texts, gain, ["row", "id", "n_words"])
    parts = crossing.unionByName(found, allowMissingColumns=True)
    return parts.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.sum("n").alias("n_features"), F.sum("gain").alias("weight"))


def _ranked(rows: DataFrame, quota: int) -> DataFrame:
    """(row, rank) of the first ``quota`` rows by score, id and row: sorted by range, numbered from the counts of the ranges."""
    order = [F.desc("score"), F.col("id").isNull(), F.col("id"), F.col("row")]
    dealt = written(rows.select("row", "id", "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(F.col("part").alias("own"), (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    met = dealt.join(F.broadcast(before.where(F.col("before") < quota)), F.col("part") == F.col("own"))  # a row a task at most
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    return met.select(F.col("row").alias("drawn"), place.cast("long").alias("rank")).where(F.col("rank") <= quota)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score and, where it is drawn, rank (from 1).

    ``percent`` of the N texts with ``least_words`` are drawn, rounded down: the highest scores, ties to the smaller id, then to the
    earlier row; a null id is the largest and counts as empty text in the hash. Null texts have no words: weight 0. Repeated rows
    each take part; an empty table gives an empty one; an empty target gives every bucket its source count alone. Other columns,
    whatever their names, are not looked at.
    """
    parts = []
    for df in (docs, target.withColumn("none", F.lit(None).cast("long"))):
        parts.append((_stored(lines(df, text_col)), _stored(texts_by_line(df, id_col if df is docs else "none", text_col))))
    gain = gains(counts(*parts[0]), counts(*parts[1]))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weights(*parts[0], gain).withColumn("score", F.col("weight") + luck))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = _ranked(able, percent * able.count() // 100)
    return scored.join(drawn, F.col("row") == F.col("drawn"), "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
