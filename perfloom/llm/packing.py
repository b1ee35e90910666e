"""Harmonic packing of token sequences into rows of fixed capacity.

Lengths are put into classes by the reciprocal of their share of the capacity: a piece of class k fits k times, and every
bin of class k is filled with exactly k pieces. Documents are cut freely, so long remainders are cut to the top of a class
(capacity // k), where bins have no waste; only the last piece of a document, of at most a sixteenth of the capacity, stays as it is.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perfloom.llm.common import numbered, ship, written

#: White space of Unicode. A text is cut where it begins; the tokenizer's own pattern never takes a token across such a place.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_OTHER = re.compile("[^\x00-\u024f]")
#: Chunks whose ids a worker remembers, and the longest such chunk in characters.
CACHED, CACHED_CHARS = 800_000, 24


class Ids:
    """Ids of texts by a byte-level BPE tokenizer file, without special tokens added, as unsigned 32-bit numbers.

    A text is tokenized in chunks of white space and what follows it, with a memory of frequent chunks. New chunks of Latin
    letters, digits and signs go through the same vocabulary in the faster public library, where it splits words alike; all
    others, and texts in which an added token's string stands, through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        # The byte alphabet of such vocabularies: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.known: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if _OTHER.search(text) else self.part(text)
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        chunks, known = _CHUNK.findall(text), self.known
        parts = list(map(known.get, chunks))
        if None in parts:
            if len(known) > CACHED:
                known.clear()
            for i, p in enumerate(parts):
                if p is None:
                    c = chunks[i]
                    p = parts[i] = known.get(c) or self.chunk(c)
                    if len(c) <= CACHED_CHARS:
                        known[c] = p
        return np.frombuffer(b"".join(parts), dtype="<u4")


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def token_ids(text: str, path: str) -> np.ndarray:
    return _ids(path)(text)


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > capacity // 16:
        piece = capacity // (capacity // (n + 1) + 1)
        out.append(piece)
        n -= piece
    return out + [n] * (n > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, and the ids themselves where wanted.

    Each document is its ids and ``end_id``; null and empty texts are that id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _ids(tokenizer), np.array([end_id], dtype="<u4")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, start, length, crc, total, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    x = np.append(ids_of(t.as_py() or ""), end)
                    at_id = 0
                    for n in cut(len(x), capacity):
                        p = x[at_id : at_id + n]
                        rows.append(i), start.append(at_id), length.append(n), crc.append(zlib.crc32(p.tobytes())), total.append(len(x))
                        if with_ids:
                            ids.append(p.astype(np.int64))
                        at_id += n
                out = [part.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out, names = [*out, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _first_fit(capacity: int, first: int, columns: list[str]):
    """First fit, longest piece first, of the few pieces that fill no bin of their class."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in columns if c not in ("length", "ids")]])
        free: list[int] = []
        seq, off = [], []
        for n in table.column("length").to_pylist():
            i = next((i for i, f in enumerate(free) if f >= n), len(free))
            if i == len(free):
                free.append(capacity)
            seq.append(first + i), off.append(capacity - free[i])
            free[i] -= n
        return table.drop_columns(["k", "number", "one"]).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    return run


def harmonic(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """``parts`` with sequence_id and offset; needs columns ``length`` (1 to ``capacity``) and ``id``, ``start``.

    Pieces of a class are numbered from 0 across all workers; k of them in turn are a bin, so workers fill bins with nothing
    exchanged but the counts per class. Fewer than k pieces of each class are left over; these, a number that the capacity
    bounds whatever the input, share bins by first fit. A sequence's id is k + (capacity + 1) * bin; left-over bins have k = 0.
    """
    cols = list(parts.columns)
    dealt = numbered(parts.withColumn("k", (F.lit(capacity) / F.col("length")).cast("long")), "k", "number")
    totals = dealt.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("k", "of")
    # One row per class, at most 2 * sqrt(capacity) classes.
    dealt = dealt.join(F.broadcast(totals), F.col("k") == F.col("of")).drop("of")
    whole = F.col("n") - F.col("n") % F.col("k")
    full = dealt.where(F.col("number") < whole).withColumn(
        "sequence_id", F.col("k") + F.lit(capacity + 1).cast("long") * F.floor(F.col("number") / F.col("k")).cast("long"))
    before = W.partitionBy("sequence_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    rest = dealt.where(F.col("number") >= whole).select(*cols, "k", "number")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"

    def shared(table: pa.Table) -> pa.Table:
        out = _first_fit(capacity, 0, cols)(table)
        ids = pa.compute.multiply(out.column("sequence_id"), capacity + 1)
        return out.set_column(out.schema.get_field_index("sequence_id"), "sequence_id", ids)

    packed = rest.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(shared, shape)
    return full.select(*cols, "sequence_id", "offset").union(packed.select(*cols, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0). Repeated rows are packed each."""
    parts = written(pieces(docs, tokenizer, capacity, end_id, id_col=id_col, text_col=text_col))
    return harmonic(parts, capacity).withColumnRenamed("id", id_col)
