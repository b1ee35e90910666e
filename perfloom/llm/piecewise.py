"""Context-triggered piecewise hashing: a text is cut where a rolling hash of the last seven bytes says so, each piece gives one
character, and texts are compared by the edit distance of these signatures.

A cut depends on the bytes around it only, so an edit changes the pieces it touches and no others. The block size, a power of two,
is how rare cuts are: the least one at which the text has fewer than ``PIECES`` cuts. A fingerprint holds the signatures at this
size, at twice and at four times it, ``size:signature:signature:signature``, so texts whose sizes differ by up to two steps are
compared at the sizes they share. No piece is left out or merged to keep a signature short. In a text that repeats a few words all
the time each place looks alike, so it has many cuts or none; such texts resemble their edited form less than others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from perfloom.llm.common import ship, written

PIECES = 64         # characters of a signature at most
LEVELS = 3          # signatures of a fingerprint, each at twice the size of the one before
CONTEXT = 7         # bytes that decide a cut
SHARED = 7          # characters in a row that two signatures share before they are compared; a third of a shorter one
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_STEP = np.uint32(0x01000193)


def _cut_hashes(data: np.ndarray) -> np.ndarray:
    """Per byte: a mixed 32-bit hash of it and the six before."""
    h = np.zeros(len(data), dtype=np.uint32)
    factor = np.uint32(1)
    for back in range(min(CONTEXT, len(data))):
        h[back:] += (data[: len(data) - back] + np.uint32(1)) * factor
        factor = factor * _STEP
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _signature(data: bytes, cuts: list[int]) -> str:
    at, out = 0, []
    for end in cuts:
        out.append(_LETTERS[zlib.crc32(data[at:end]) & 63])
        at = end
    if at < len(data):
        out.append(_LETTERS[zlib.crc32(data[at:]) & 63])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """Size and signatures of the text's UTF-8 bytes, ``1:::`` for an empty or null text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    with np.errstate(over="ignore"):
        h = _cut_hashes(np.frombuffer(data, dtype=np.uint8).astype(np.uint32))
    # A byte ends a piece at size 2^k if the hash ends in k ones; bits = number of ones it ends in.
    ones = ~h & (h + np.uint32(1))
    bits = np.where(ones == 0, 32, np.frexp(ones.astype(np.float64))[1] - 1)
    fewer = len(bits) - np.concatenate(([0], np.cumsum(np.bincount(bits, minlength=34))))  # [k]: cuts at size 2^k
    k = int(np.argmax(fewer < PIECES))
    return ":".join([str(1 << k), *(_signature(data, (np.flatnonzero(bits >= level) + 1).tolist()) for level in range(k, k + LEVELS))])


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one addition of long integers a character."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        kept = row & where.get(c, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (characters of both); 0 where they share no long enough stretch of characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = min(SHARED, -(-min(len(a), len(b)) // 3))
    grams = {a[i : i + size] for i in range(len(a) - size + 1)}
    if grams.isdisjoint(b[i : i + size] for i in range(len(b) - size + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints, 0 to 1: the better of the signatures at block sizes that both have; 0 where they share none."""
    if one == other:
        return 1.0
    (s, *a), (t, *b) = one.split(":"), other.split(":")
    at = {int(s) << i: x for i, x in enumerate(a)}
    return max((_alike(at[int(t) << i], x) for i, x in enumerate(b) if int(t) << i in at), default=0.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of each whole text in column ``name``."""
    ship(docs.sparkSession)

    def run(texts):
        return texts.map(fingerprint, na_action=None)

    return docs.withColumn(name, F.pandas_udf(run, "string")(F.coalesce(F.col(text_col), F.lit(""))))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _compared(text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    mark = fingerprint(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, mark,
            likeness(own, mark), likeness(own, next_own))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, and its fingerprint against those of its edited text and of the next document.

    Documents follow each other by ascending id, null ids last, equal ids by a hash of the text; after the last comes the first, and
    a single document follows itself. Null texts count as empty. Repeated rows give repeated rows, an empty table an empty one;
    other columns, whatever their names, are not looked at. Texts are sorted by range once and streamed through their tasks; of
    each task only the first and the last row, which meet across tasks, go further. Equal rows are told apart by their place, so
    a group of copies is dealt to several tasks.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    order: list[Column] = [F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("place")]
    ends = f"id {kind}, {_OUT}, task int, first string, last string"
    id_type = rows.limit(0).toArrow().schema.field("id").type
    out_types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch(ids: list, got: list[tuple], task: int | None = None, first: str | None = None, last: str | None = None) -> pa.RecordBatch:
        columns = [pa.array([g[k] for g in got], t) for k, t in enumerate(out_types)]
        extra = [pa.array([v] * len(ids), t) for v, t in ((task, pa.int32()), (first, pa.string()), (last, pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns, *extra], ["id", *_NAMES, "task", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, task = None, None, TaskContext.get().partitionId()
        for b in batches:
            ids, got = [], []
            for i, t in zip(b.column("id"), b.column("text")):
                text = t.as_py()
                own = fingerprint(text)
                if held is None:
                    first = text
                else:
                    ids.append(held[0])
                    got.append(_compared(held[1], held[2], text, own))
                held = (i.as_py(), text, own)
            yield batch(ids, got)
        if held is not None:
            yield batch([held[0]], [(None,) * len(_NAMES)], task, first, held[1])

    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").mapInArrow(run, ends))
    done = parts.where("task is null").select("id", *_NAMES)
    # One row a task: the task after it, then that task's first text by a join, so texts do not meet in one place.
    edge = parts.where("task is not null")
    after = edge.select("task").select("task", F.coalesce(
        F.lead("task").over(W.orderBy("task")), F.min("task").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    firsts = edge.select(F.col("task").alias("after"), F.col("first").alias("following"))
    met = edge.select("id", "task", "last").join(after, "task").join(firsts, "after").select("id", "last", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_compared(x, fingerprint(x), y, fingerprint(y)) for x, y in zip(b.column("last").to_pylist(), b.column("following").to_pylist())]
            yield batch(b.column("id").to_pylist(), got).select(["id", *_NAMES])

    return done.unionByName(met.mapInArrow(close, f"id {kind}, {_OUT}")).withColumnRenamed("id", id_col)
