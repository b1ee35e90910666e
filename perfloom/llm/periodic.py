"""Periodic runs of words: an online pass over each text that keeps one match length per active diagonal.

A diagonal of lag q matches at word i if words i and i - q are equal; q * exponent words with period q are a stretch of matches on
it. Every earlier occurrence of a word would open a diagonal, which is quadratic for frequent words. Two facts keep them sparse
without losing a run. (1) A run of period q has at least ``need(q)`` matches, so a diagonal opens only at earlier occurrences of the
word that agree in the following words as well; lags are handled in bands [2^t, 2^(t+1)), each with the least need of its lags.
(2) Of these the nearest is enough: the agreeing words number at least 1.5 times the greatest lag of the band, so if a nearer one
exists at lag p, the stretch has period p too, p divides q (theorem of Fine and Wilf), and q is not its smallest period.
So each word opens at most one diagonal a band, and work is n log n for any text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import ship

FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space; none for a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def planted(words: list, doc_id: int | None) -> list:
    """One text in ten, chosen by crc32 of the id, with a periodic tail: word i >= a becomes word a + (i - a) % p.

    A null id counts as empty text.
    """
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def need(q: int, times: int, least: int) -> int:
    """Matches that a run of period ``q`` has at least: its length is at least ``least`` and ``times`` periods."""
    return max(least, times * q) - q


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: equal exactly where both parts are."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _openings(ids: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """(word, lag) of every diagonal that opens, by word."""
    n, out, low = len(ids), [], 1
    grams = [ids]  # grams[k]: names of the stretches of 2^k words
    turn = -(-least // times)  # the need falls up to this lag, then rises

    def smallest_need(lo: int, hi: int) -> int:
        return min(need(min(max(q, lo), hi), times, least) for q in (lo, hi, turn - 1, turn))

    def named(length: int) -> np.ndarray | None:
        """Names of the stretches of ``length`` words: two that overlap, of the greatest power of two."""
        k = length.bit_length() - 1
        while len(grams) <= k:
            half = 1 << (len(grams) - 1)
            if len(grams[-1]) <= half:
                return None
            grams.append(_pairs(grams[-1][:-half], grams[-1][half:]))
        count = n - length + 1
        if count < 2:
            return None
        rest = length - (1 << k)
        return grams[k][:count] if not rest else _pairs(grams[k][:count], grams[k][rest : rest + count])

    while low < n:
        size = smallest_need(low, 2 * low - 1)
        names = named(size)
        order = np.zeros(0, dtype=np.int64) if names is None else np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]] if len(order) else np.zeros(0, dtype=bool)
        if not same.any():
            low *= 2
            if smallest_need(low, max(low, n)) >= size:  # longer stretches do not repeat either
                break
            continue
        lag = np.zeros(len(names), dtype=np.int64)
        lag[order[1:][same]] = (order[1:] - order[:-1])[same]
        lag[(lag < low) | (lag >= 2 * low)] = 0
        before = np.concatenate(([0], lag[:-1]))
        at = np.flatnonzero((lag > 0) & (lag != before))
        out += zip(at.tolist(), lag[at].tolist())
        low *= 2
    return sorted(out)


def runs(words: list, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch of words with smallest period q and at least ``max(least, times * q)`` words that no neighbouring word
    extends with that period. ``times`` is 4 or more: the bands' proof needs three periods of matches.
    """
    if times < 4 or least < 1:
        raise ValueError("times must be at least 4 and least at least 1")
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    if len(ids) < max(least, times) or len(names) == len(ids):
        return []
    opened = _openings(ids, times, least)
    if not opened:
        return []
    row, out = ids.tolist(), []
    active: dict[int, int] = {}  # lag of an active diagonal: its matches so far
    at, i, n = 0, 0, len(row)
    while i < n or active:
        if not active:
            if at == len(opened):
                break
            i = opened[at][0]  # nothing matches before the next opening
        ended = [q for q in active if i == n or row[i] != row[i - q]]
        for q in ended:
            m = active.pop(q)
            if m >= need(q, times, least):
                out.append((i - m - q, m + q, q))
        if i == n:
            break
        while at < len(opened) and opened[at][0] == i:
            active.setdefault(opened[at][1], 0)
            at += 1
        for q in active:
            active[q] += 1
        i += 1
    return sorted(out)


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay: a run keeps its first period only."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        drop[start + q] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)
    return [w for w, k in zip(words, gone.tolist()) if not k]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    best = None
    for run in found:  # by start and period, so only a greater exponent replaces
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _row(words: list[bytes]) -> tuple:
    found = runs(words)
    top = strongest(found)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(collapsed(words, found) if found else words)
    return (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def report(docs: DataFrame, alter: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and the columns of ``FIELDS``, over whole texts; ``alter`` plants periodic tails first.

    Null, empty and blank texts have no words: no run, four nulls, both digests of the empty text. Repeated rows give repeated rows;
    an empty table gives an empty one. Other columns, whatever their names, are not looked at.
    """
    schema = pa.schema([("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")),
                        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i, t in zip(b.column(0), b.column(1)):
                words = words_of(t.as_py())
                got.append(_row(planted(words, i.as_py()) if alter else words))
            columns = [pa.array([g[k] for g in got], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, *schema.names])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
