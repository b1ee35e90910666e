"""Quality classifier: Naive Bayes support vectors.

A text's indicators of byte n-grams and of repeated-word patterns are scaled by the classes' log-count ratios and by their
length as a vector; a linear hinge-loss model on them is fitted by dual coordinate descent. A logistic curve fitted on rows
that the model has not seen turns its margin into a score from 0 to 1.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import fresh, id_remainder, ship

BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
_PATTERN = {(lag, j): zlib.crc32(f"repeat {lag} {j}".encode()) >> (32 - BITS) for lag in (1, 2, 3, 4) for j in range(len(_SHARES) + 2)}


def _repeats(words: list[str]) -> list[int]:
    """Patterns of words that equal the word 1 to 4 places before: how large a share, and runs of three and four."""
    out = []
    for lag in (1, 2, 3, 4):
        same = np.fromiter(map(operator.eq, words, words[lag:]), bool, max(0, len(words) - lag))
        share = same.mean() if len(same) else 0.0
        out += [_PATTERN[lag, j] for j, s in enumerate(_SHARES) if share >= s]
        twice = same[1:] & same[:-1]
        if twice.any():
            out.append(_PATTERN[lag, len(_SHARES)])
            if (twice[1:] & same[:-2]).any():
                out.append(_PATTERN[lag, len(_SHARES) + 1])
    return out


class Indicators:
    """Distinct hashed n-grams of whole texts; keeps one flag per hash value between texts."""

    def __init__(self, longest: int = 4):
        self.longest, self.flags = longest, np.zeros(1 << BITS, dtype=bool)

    def __call__(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
        code = np.zeros(len(b), dtype=np.uint64)
        for n in range(1, min(self.longest, len(b)) + 1):
            code = code[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :] + np.uint64(1)
            self.flags[((code + np.uint64(n << 40)) * _MIX) >> np.uint64(64 - BITS)] = True
        self.flags[_repeats(text.split())] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        return float(self.weight[x] @ r) / max(float(np.sqrt(r @ r)), 1e-12) + self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratio(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for x, good in zip(xs, y):
        (p if good else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss weights: one dual variable per row, raised or lowered to its best value within 0 and ``cost`` in turn."""
    rng = np.random.default_rng(seed)
    weight, bias, sign, dual = np.zeros(1 << BITS), 0.0, np.where(y, 1.0, -1.0), np.zeros(len(y))
    norm = [max(float(np.linalg.norm(ratio[x])), 1e-12) for x in xs]
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            value = ratio[xs[i]] / norm[i]
            slope = sign[i] * (weight[xs[i]] @ value + bias) - 1.0
            new = min(max(dual[i] - slope / (float(value @ value) + 1.0), 0.0), cost)  # the bias is a feature of value 1
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[xs[i]] += step * value
                bias += step
                dual[i] = new
    return weight, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(xs: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of labelled rows; with one class only, or none, every score is the share of good rows (1 / 2 without rows)."""
    zero = np.zeros(1 << BITS)
    if not len(y) or y.all() or not y.any():
        return Model(zero, zero, 0.0, 0.0, 30.0 * (float(y.mean()) * 2 - 1) if len(y) else 0.0)
    margins = np.empty(len(y))
    fold = np.arange(len(y)) % 3
    for k in range(3):
        fit = np.flatnonzero(fold != k)
        if not y[fit].any() or y[fit].all():
            fit = np.arange(len(y))
        part = [xs[i] for i in fit]
        ratio = log_count_ratio(part, y[fit])
        model = Model(ratio, *dual_descent(part, y[fit], ratio), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(xs[i])
    ratio = log_count_ratio(xs, y)
    return Model(ratio, *dual_descent(xs, y, ratio), *_logistic(margins, y))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model of at most ``per_class`` labelled documents of each class, the same ones whatever the order of rows.

    One task fits it, as it is sequential; its input is bounded by ``per_class``, and two vectors come back. Rows whose id's crc32 modulo 4 is 2 are held out. Null labels, ids and texts that are missing are not learned from.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_remainder(F.col(id_col), 4) != 2)).distinct()
    order = [F.xxhash64("id"), F.col("id")]
    picked = [known.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(picked[0].union(picked[1])), "id")  # at most 2 * per_class ids

    def indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Indicators()
        for b in batches:
            xs = [of(t.as_py()).astype(np.int32) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(str(i.as_py()).encode()) for i in b.column(0)], pa.int64()), b.column(1),
                                              pa.array(xs, pa.list_(pa.int32()))], ["key", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            at, all_x = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            got += [(k, label, all_x[at[i] : at[i + 1]].copy()) for i, (k, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))]
        got.sort(key=lambda g: g[:2])
        m = train([g[2] for g in got], np.array([g[1] for g in got], dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([m.ratio.tobytes()]), pa.array([m.weight.tobytes()]), *[pa.array([x]) for x in (m.bias, m.slope, m.shift)]],
                                         ["ratio", "weight", "bias", "slope", "shift"])

    found = rows.select("id", "label", "text").mapInArrow(indicate, "key long, label int, x array<int>").repartition(1).mapInArrow(
        learn, "ratio binary, weight binary, bias double, slope double, shift double").first()
    if found is None:
        return train([], np.zeros(0, dtype=bool))
    return Model(np.frombuffer(found["ratio"]), np.frombuffer(found["weight"]), found["bias"], found["slope"], found["shift"])


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All rows and columns of ``docs`` with score and predicted (1 from ``threshold`` on). A null text scores as an empty one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2^18 numbers

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Indicators()
        for texts in batches:
            yield texts.map(lambda t: shared.value.score(of(t))).astype("float64")

    value = score_of(F.coalesce(F.col(text_col), F.lit("")))
    name = fresh(docs, score)
    return docs.withColumn(name, value).withColumn(fresh(docs, predicted), (F.col(name) >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they are."""
    name = fresh(docs, "score")
    return scored(docs, model, threshold, text_col, name).where(F.col(name) >= threshold).select(*docs.columns)
