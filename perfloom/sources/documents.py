"""Objects out of JSON documents of any size, read by many tasks.

Spark's text source splits files at any separator, so a document of one line is read in pieces that end at ``}``. What a piece means
depends on where in the document it begins: inside which containers, and whether inside a string. Each split is summarised on its
own as a function of that state (for both string states: how many containers it closes and which it leaves open), the summaries
of a file are composed in order, and every split is then cut with the right state in hand. A task holds one piece and the object
it is in, never a document; objects that reach over the end of a split are put together from their parts.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfloom.shared import ship, written

# A string (group 2: its closing quote, group 3: the colon after a key) or a bracket, in text that begins outside a string.
_STRUCTURE = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)(?:(")(\s*:)?|\Z)|([{}\[\]])', re.S)
_STRING_END = re.compile(r'([^"\\]*(?:\\.[^"\\]*)*)(?:(")(\s*:)?|\Z)', re.S)
_ENTRY = "\0"  # stands for the part of a string before a split; no JSON text holds it

#: Path to the containers whose objects are read: keys from the root down, None for any key.
Under = tuple[str | None, ...]


class _Text:
    """Reads pieces in order and keeps the text of a string that is still open."""

    def __init__(self, open_string: str | None = None):
        self.open_string = open_string

    def brackets(self, text: str) -> Iterator[tuple[int, str, str | None]]:
        """(position, bracket, key before it) of every bracket outside strings."""
        at, key = 0, None
        if self.open_string is not None:
            m = _STRING_END.match(text)
            if not m[2]:
                self.open_string += text
                return
            key = self.open_string + m[1] if m[3] else None
            self.open_string, at = None, m.end()
        for m in _STRUCTURE.finditer(text, at):
            if m[4]:
                yield m.start(), m[4], key
                key = None
            elif m[2]:
                key = m[1] if m[3] else None
            else:
                self.open_string = m[1]


class _Summary:
    """What a split does to the containers around it, if it begins inside a string or not."""

    def __init__(self, in_string: bool):
        self.text = _Text(_ENTRY if in_string else None)
        self.closed, self.opened = 0, []

    def add(self, text: str) -> None:
        for _, bracket, key in self.text.brackets(text):
            if bracket in "{[":
                self.opened.append((key, bracket))
            elif self.opened:
                self.opened.pop()
            else:
                self.closed += 1


class _Summaries:
    def __init__(self, file: str, block: int):
        self.file, self.block, self.both = file, block, (_Summary(False), _Summary(True))

    def add(self, seq: int, piece: str) -> Iterator[tuple]:
        for s in self.both:
            s.add(piece + "}")
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield self.file, self.block, json.dumps([[s.text.open_string, s.closed, s.opened] for s in self.both])


def _after(state: list, summary: str) -> list:
    """[open string, containers] after a split that began in ``state``."""
    before, stack = state
    text, closed, opened = json.loads(summary)[0 if before is None else 1]

    def whole(s: str | None) -> str | None:
        return before + s[1:] if s and s[0] == _ENTRY else s

    return [whole(text), stack[: max(0, len(stack) - closed)] + [[whole(k), b] for k, b in opened]]


def _key(raw: str | None) -> str | None:
    return json.loads(f'"{raw}"') if raw is not None and "\\" in raw else raw


def _is_under(stack: Sequence[Sequence], kind: str, under: Sequence[Under]) -> bool:
    """Whether the innermost container of ``stack`` is one whose objects are read."""
    return bool(stack) and stack[-1][1] == kind and any(
        len(path) == len(stack) - 1 and all(k is not None and p in (None, _key(k)) for p, (k, _) in zip(path, stack[1:])) for path in under)


class _Cutter:
    """Cuts the objects under the wanted containers out of the pieces of one split."""

    def __init__(self, file: str, block: int, state: list, kind: str, under: Sequence[Under]):
        self.file, self.block = file, block
        self.text, self.stack = _Text(state[0]), [tuple(c) for c in state[1]]
        self.kind, self.under = kind, under
        # the place on the stack of the object that is being read; ``first`` is None where it began in an earlier split
        self.level = next((i for i in range(1, len(self.stack)) if self.stack[i][1] == "{" and _is_under(self.stack[:i], kind, under)), None)
        self.parts, self.first = [], None

    def add(self, seq: int, piece: str) -> Iterator[tuple]:
        text, start = piece + "}", 0
        for at, bracket, key in self.text.brackets(text):
            if bracket in "{[":
                if self.level is None and bracket == "{" and _is_under(self.stack, self.kind, self.under):
                    self.level, self.first, start = len(self.stack), seq, at
                self.stack.append((key, bracket))
                continue
            if self.level is not None and self.level == len(self.stack) - 1:
                self.parts.append(text[start : at + 1])
                yield self._row(True)
                self.level, self.parts, self.first = None, [], None
            if self.stack:
                self.stack.pop()
        if self.level is not None:
            self.parts.append(text[start:])

    def end(self) -> Iterator[tuple]:
        if self.level is not None:
            yield self._row(False)

    def _row(self, ends: bool) -> tuple:
        keys = None if self.first is None else [_key(k) for k, _ in self.stack[1 : self.level + 1]]
        return self.file, self.block, self.first, keys, "".join(self.parts), ends


_ROWS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("keys", pa.list_(pa.string())), ("text", pa.string()), ("ends", pa.bool_())])
_CUT = "file string, block long, seq long, keys array<string>, text string, ends boolean"


def by_split(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator[tuple]:
    """Rows that ``begin(file, block, state)`` objects give: ``add(number, piece)`` for each piece, ``end()`` after a split's last."""
    unit, at = None, None
    for b in batches:
        for file, block, value, state in zip(*(b.column(c).to_pylist() for c in range(4))):
            if at is None or at[:2] != [file, block]:
                if unit is not None:
                    yield from unit.end()
                unit, at = begin(file, block, state), [file, block, block]
            yield from unit.add(at[2], value)
            at[2] += 1
    if unit is not None:
        yield from unit.end()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"), "value",
        (m["file_block_length"] < m["file_size"]).alias("split"))


def _entry_states(pieces: DataFrame) -> DataFrame:
    """(at_file, at_block, state): the state in which each split begins, of the files that have several."""
    found = pa.schema([("file", pa.string()), ("block", pa.int64()), ("does", pa.string())])
    known = pa.schema([("at_file", pa.string()), ("at_block", pa.int64()), ("state", pa.string())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(by_split(batches, lambda file, block, _: _Summaries(file, block)), found, 64)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states():
            last, state = None, None
            for b in batches:
                for file, block, does in zip(*(b.column(c).to_pylist() for c in range(3))):
                    if file != last:
                        last, state = file, [None, []]
                    yield file, block, json.dumps(state)
                    state = _after(state, does)

        return batches_of(states(), known, 64)

    per = pieces.where("split").select("file", "block", "value", F.lit("").alias("state")).mapInArrow(summarise, "file string, block long, does string")
    return per.repartition("file").sortWithinPartitions("file", "block").mapInArrow(compose, "at_file string, at_block long, state string")


def json_objects(spark: SparkSession, path: str, under: Sequence[Under], kind: str = "[") -> DataFrame:
    """``file, seq, keys, text``: every object directly inside the wanted containers of JSON documents.

    ``under`` names containers by their keys from the root down: ``()`` is the root itself, ``("traceEvents",)`` the value of that
    key of a root object, None any key; ``kind`` says whether they are arrays (``[``) or objects (``{``). ``keys`` are the keys on
    the way to the object, its own last, null for an item of an array. ``seq`` is unique in a file and ascends with it. Other
    items of the containers are left out; a document that breaks off gives its whole objects, the last one also where only its
    last brace is missing. The broadcast table has one row for each split of the files that are too large for one. The cut rows go to
    the shared folder once, as those on both sides of a split's end are read apart.
    """
    ship(spark)
    pieces, under = _pieces(spark, path), [tuple(u) for u in under]
    states = F.broadcast(_entry_states(pieces))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(by_split(batches, lambda file, block, state: _Cutter(file, block, json.loads(state), kind, under)), _ROWS)

    at = pieces.join(states, (F.col("file") == F.col("at_file")) & (F.col("block") == F.col("at_block")), "left")
    # Both passes must see the same splits; cluster settings that change between them would be noticed here.
    moved = F.when(F.col("split"), F.raise_error(F.lit("files were split anew while they were read; set spark.sql.files.minPartitionNum")))
    known = at.select("file", "block", "value", F.coalesce("state", moved, F.lit('[null, []]')).alias("state"), "split")
    rows = written(known.select("file", "block", "value", "state").mapInArrow(cut, _CUT))  # cut once, read twice
    whole = rows.where(F.col("seq").isNotNull() & F.col("ends")).select("file", "seq", "keys", "text")
    parts = rows.where(F.col("seq").isNull() | ~F.col("ends"))
    return whole.union(joined_parts(parts, "keys").where("ends").select("file", "seq", "keys", "text"))


def joined_parts(parts: DataFrame, *first: str) -> DataFrame:
    """Units that reach over the ends of splits, from their parts: ``file, block, seq`` (null but for a first part), ``text, ends``.

    A split has at most two parts here. The ``first`` columns come from the first part.
    """
    later = F.col("seq").isNull()
    # what ends in a split comes before what begins in it
    order = Window.partitionBy("file").orderBy("block", F.col("seq").isNotNull())
    begins = ~later | F.lag("ends", 1, False).over(order)
    return parts.withColumn("begins", begins).withColumn("unit", F.sum(F.col("begins").cast("int")).over(order)).groupBy("file", "unit").agg(
        F.max("seq").alias("seq"), *(F.first(c, True).alias(c) for c in first), F.bool_or("ends").alias("ends"),
        F.concat_ws("", F.sort_array(F.collect_list(F.struct("block", (~later).alias("begins"), "text")))["text"]).alias("text"))
