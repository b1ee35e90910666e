"""Nearest neighbours: inverted lists, and in each probed list a scan by column blocks that gives candidates up early.

Vectors are turned by one random rotation, after which a partial distance over the first d columns estimates the whole
one. After each block of columns a candidate is tested against the hypothesis that it is among the k nearest; it leaves once
its scaled partial distance exceeds the k-th best by more than chance allows. Survivors get exact distances on the original
vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perfloom.llm.common import ship, written

#: Vectors that the index is fitted on at most, and those of them that measure recall.
SAMPLE, PROBERS = 20_000, 256
#: Rows and queries that meet in one task at most (on average; a hash deals them).
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1_024
MAX_LISTS = 1_024
#: Columns per block, and the number of standard errors that the test allows.
COLUMNS, ERRORS = 16, 2.1


def usable(vec: Column) -> Column:
    """Vectors without null and non-finite components that are not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _order(x, c, 1)[:, 0]
        total, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def _order(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int64)
    for at in range(0, len(x), 2048):
        d = (c * c).sum(1) - 2 * x[at : at + 2048] @ c.T
        out[at : at + 2048] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def fit(sample: np.ndarray, rows: int, k: int, recall: float, seed: int = 7) -> tuple[np.ndarray, int, float]:
    """Centres, number of lists to probe, and the recall measured for it on the sample against brute force."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(MAX_LISTS, int(math.sqrt(rows) / 2), len(sample) // 20))
    c = _centres(sample, lists, rng)
    asked = rng.choice(len(sample), min(PROBERS, len(sample)), replace=False)
    home, order = _order(sample, c, 1)[:, 0], _order(sample[asked], c, lists)
    rank = np.empty((len(asked), lists), dtype=np.int64)
    np.put_along_axis(rank, order, np.arange(lists)[None, :], axis=1)
    need = []
    for i, q in enumerate(asked):
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        need.append(rank[i, home[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]]])
    need = np.concatenate(need) if need else np.zeros(0)
    for probes in range(1, lists + 1):
        if not len(need) or (got := float((need < probes).mean())) >= recall:
            break
    return c, probes, got if len(need) else 1.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _kth(distance: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The k-th least distance of different ids; without bound where there are fewer."""
    near = np.argsort(distance, kind="stable")
    first = np.unique(ids[near], return_index=True)[1]
    return float(distance[near[np.partition(first, k - 1)[k - 1]]]) if len(first) >= k else math.inf


def scan(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, turn: np.ndarray, k: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query the rows that survive every test; ``own`` (per query) are rows to leave out, ``ids`` name the rows."""
    dim = rows.shape[1]
    q_turned, turned = queries @ turn, rows @ turn
    for i in range(len(queries)):
        alive = np.flatnonzero(~own[i])
        if len(alive) > 4 * k:
            # The k-th best id of some rows bounds the k-th best of all.
            first = alive[:: max(1, len(alive) // (8 * k))]
            bound = _kth(((rows[first] - queries[i]) ** 2).sum(1), ids[first], k)
            part = np.zeros(len(alive))
            for at in range(0, dim, COLUMNS):
                d = min(at + COLUMNS, dim)
                part += ((turned[alive, at:d] - q_turned[i, at:d]) ** 2).sum(1)
                limit = bound * (1 + ERRORS / math.sqrt(d)) ** 2 * d / dim if d < dim else bound * (1 + 1e-9)
                keep = part <= limit
                alive, part = alive[keep], part[keep]
        yield i, alive


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest rows found of each query row, ties to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part, nor do
    rows without id. Rows of a query's own id are no candidates for it; of a repeated id the nearest row counts.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    id_type = good.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return empty
    dim, n = sizes["dim"], sizes["n"]
    good = good.where(F.size("v") == dim)
    picked = good.select("v").orderBy(F.xxhash64("id"), "v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    # different vectors: copies would find each other in any list and make the recall look better than it is
    sample = np.unique(picked.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), axis=0)
    centres, probes, _ = fit(sample, n, k, recall)
    turn = rotation(dim)

    def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _order(matrix(b.column("v")), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("asks"), pa.array(near)], ["id", "v", "asks", "list"])

    def probing(n: int):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = _order(matrix(b.column("v")), centres, n)
                    rows = pa.array(np.repeat(np.arange(b.num_rows), n))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("v").take(rows), pa.array(near.ravel())], ["id", "v", "list"])

        return probe

    rows = written(good.mapInArrow(home, f"id {id_type}, v array<double>, asks boolean, list long"))
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    # At most MAX_LISTS rows each: how many blocks a list's rows and queries are dealt to.
    blocks = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("row_blocks")))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q, r, s = [], [], []
        if a.num_rows and b.num_rows:
            x, y = matrix(a.column("v").combine_chunks()), matrix(b.column("v").combine_chunks())
            ids, q_ids = np.array(a.column("id").to_pylist()), np.array(b.column("id").to_pylist())
            for i, alive in scan(y, x, ids[None, :] == q_ids[:, None], turn, k, ids):
                d = np.sqrt(((x[alive] - y[i]) ** 2).sum(1))
                # Distinct ids first: copies of one row must not take the places of others.
                order = np.lexsort((ids[alive], d))
                _, at = np.unique(ids[alive][order], return_index=True)
                top = order[np.sort(at)[:k]]
                q += [q_ids[i]] * len(top)
                r += ids[alive][top].tolist()
                s += d[top].tolist()
        return pa.table({"query_id": pa.array(q, b.schema.field("id").type), "vec_id": pa.array(r, b.schema.field("id").type), "score": pa.array(s, pa.float64())})

    def found(asked: DataFrame, lists: int) -> DataFrame:
        """(query_id, vec_id, score) of the best rows of each block of the ``lists`` nearest lists."""
        probed = asked.select("id", "v").mapInArrow(probing(lists), f"id {id_type}, v array<double>, list long")
        q_blocks = F.broadcast(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("q_blocks")))
        left = rows.join(blocks, "list").join(q_blocks, "list").select(
            "list", F.pmod(F.xxhash64("id", "v"), "row_blocks").alias("rb"), each("q_blocks").alias("qb"), "id", "v")
        right = probed.join(blocks, "list").join(q_blocks, "list").select(
            "list", F.pmod(F.xxhash64("id"), "q_blocks").alias("qb"), each("row_blocks").alias("rb"), "id", "v")
        met = left.groupBy("list", "rb", "qb").cogroup(right.groupBy("list", "rb", "qb")).applyInArrow(
            meet, f"query_id {id_type}, vec_id {id_type}, score double")
        return met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    best = written(found(queries, probes))
    if probes < len(centres):
        # Queries whose lists held fewer than k others go through all lists.
        short = queries.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")), F.col("id") == F.col("query_id"), "left").where(
            F.coalesce("got", F.lit(0)) < k).select("id", "v")
        if not short.isEmpty():
            best = best.join(short, F.col("query_id") == F.col("id"), "left_anti").union(found(short, len(centres)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
