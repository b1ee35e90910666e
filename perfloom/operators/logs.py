"""Metrics and launch arguments out of service logs; one row per line: ``log_id, seq, value``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.sequence import KeyedSequence
from perfloom.shared import ship

LK = ("log_id",)
# Fixed values: (metric, pattern, unit) in matching order; a unit of None takes the second group.
WEIGHT = ("model_weight_memory", r"Loading model weights took\s*([\d.]+)\s*(GB|GiB|MB|MiB)", None)
LINE_PATTERNS = (
    ("kv_cache_memory", r"Available KV cache memory:\s*([\d.]+)\s*(GB|GiB|MB|MiB)", None),
    ("kv_cache_usage", r"GPU KV cache usage:\s*([\d.]+)\s*%", "%"),
    ("prefix_cache_hit_rate", r"Prefix cache hit rate:\s*([\d.]+)\s*%", "%"),
    ("draft_acceptance_rate", r"Avg Draft acceptance rate\s*:\s*([\d.]+)\s*%", "%"),
    ("mean_acceptance_length", r"Mean acceptance length\s*:\s*([\d.]+)", ""),
    ("generation_throughput", r"Avg generation throughput:\s*([\d.]+)\s*tokens/s", "tokens/s"),
    ("accepted_throughput", r"Accepted throughput:\s*([\d.]+)\s*tokens/s", "tokens/s"),
    ("drafted_throughput", r"Drafted throughput:\s*([\d.]+)\s*tokens/s", "tokens/s"),
    ("accepted_tokens", r"Accepted\s*:\s*(\d+)\s*tokens", "tokens"),
    ("drafted_tokens", r"Drafted\s*:\s*(\d+)\s*tokens", "tokens"),
)
AGGREGATED = (r"(\d+)\s+Engines?\s+Aggregated:\s*Avg prompt throughput:\s*([\d.]+)\s*tokens/s,?"
              r"\s*Avg generation throughput:\s*([\d.]+)\s*tokens/s,?\s*Running:\s*\d+\s+reqs,?\s*Waiting:\s*\d+\s+reqs,?"
              r"\s*GPU KV cache usage:\s*([\d.]+)%,?\s*Prefix cache hit rate:\s*([\d.]+)%")
AGGREGATED_GROUPS = (("generation_throughput", 3, "tokens/s"), ("kv_cache_usage", 4, "%"), ("prefix_cache_hit_rate", 5, "%"))
# Launch arguments kept by the interest filter, in the order of the service's settings.
INTEREST = (
    "quantization", "tensor_parallel_size", "enable_expert_parallel", "data_parallel_size", "pipeline_parallel_size",
    "max_model_len", "max_num_batched_tokens", "max_num_seqs", "enable_prefix_caching", "enable_chunked_prefill",
    "cudagraph_mode", "cudagraph_capture_size", "multistream_overlap_shared_expert", "enable_npugraph_ex",
    "recompute_scheduler_enable", "enable_flashcomm1", "enable_fused_mc2", "enable_dsa_cp", "speculative_config",
    "num_spec_tokens", "model",
)
INTEREST_PREFIXES = ("enable_", "fuse_", "cudagraph_", "multistream_", "recompute_")
INTEREST_TOKEN = "eagle3"
PARALLEL_KEYS = ("tensor_parallel_size", "enable_expert_parallel", "data_parallel_size", "pipeline_parallel_size")
CONFIG_KEYS = ("max_model_len", "max_num_batched_tokens", "max_num_seqs")


def line_metrics(lines: DataFrame, patterns=LINE_PATTERNS, first=WEIGHT, K: Sequence[str] = LK) -> DataFrame:
    """(metric, seq, value, unit): the first matching pattern of each line."""
    v = F.col("value")

    def hit(metric, pattern, unit):
        return F.struct(F.lit(metric).alias("metric"), F.regexp_extract(v, pattern, 1).alias("number"),
                        (F.regexp_extract(v, pattern, 2) if unit is None else F.lit(unit)).alias("unit"))

    rules = ([first] if first else []) + list(patterns)
    found = X.first_match(*[(v.rlike(p), hit(m, p, u)) for m, p, u in rules])
    # a generator evaluates the long CASE once per line; plain field access would repeat it per output column
    return lines.select(*K, "seq", F.inline(F.array(found))).where("metric is not null").select(
        *K, "metric", "seq", F.col("number").alias("value"), "unit")


def first_seen_distinct(df: DataFrame, keys: Sequence[str], value: str, order: str = "seq") -> DataFrame:
    """Distinct values per key with the position they were first seen at."""
    return df.groupBy(*keys, value).agg(F.min(order).alias("first_seq"))


def aggregated_metrics(lines: DataFrame, K: Sequence[str] = LK, pattern: str = AGGREGATED, groups=AGGREGATED_GROUPS,
                       weight=WEIGHT, memory=LINE_PATTERNS[0]) -> DataFrame:
    """Metrics of summary lines (several per line), distinct weight values, and the first cache memory value."""
    v = F.col("value")
    is_weight, is_memory = v.rlike(weight[1]), v.rlike(memory[1])
    agg = lines.where(~is_weight & ~is_memory & v.rlike(pattern)).select(*K, "seq", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.regexp_extract(v, pattern, g).alias("value"), F.lit(u).alias("unit"))
        for m, g, u in groups])))
    singles = lines.where(is_weight | is_memory).select(
        *K, "seq", F.when(is_weight, weight[0]).otherwise(memory[0]).alias("metric"),
        F.when(is_weight, F.regexp_extract(v, weight[1], 1)).otherwise(F.regexp_extract(v, memory[1], 1)).alias("value"),
        F.when(is_weight, F.regexp_extract(v, weight[1], 2)).otherwise(F.regexp_extract(v, memory[1], 2)).alias("unit"))
    weights = singles.where(F.col("metric") == weight[0]).groupBy(*K, "metric", "value", "unit").agg(F.min("seq").alias("seq"))
    mem = singles.where(F.col("metric") == memory[0]).groupBy(*K, "metric").agg(
        F.min_by(F.struct("value", "unit"), "seq").alias("_b"), F.min("seq").alias("seq")).select(
        *K, "metric", "_b.value", "_b.unit", "seq")
    cols = [*K, "metric", "seq", "value", "unit"]
    return agg.select(*cols).unionByName(weights.select(*cols)).unionByName(mem.select(*cols))


def log_format(lines: DataFrame, K: Sequence[str] = LK, aggregated: str = AGGREGATED, weight: str = WEIGHT[1]) -> DataFrame:
    v = F.col("value")
    return lines.groupBy(*K).agg(F.when(F.bool_or(v.rlike(aggregated)), "b").when(F.bool_or(v.rlike(weight)), "a").otherwise(
        "unknown").alias("format"))


def transpose(metrics: DataFrame, K: Sequence[str] = LK, columns: int = 0, split_rows: int | None = None) -> DataFrame:
    """(metric, k, value): every occurrence of a metric under its number.

    ``columns`` lays that many of the first out side by side for display instead, with the number of all of them.
    """
    ranked = KeyedSequence(metrics, [*K, "metric"], ["seq"], split_rows).rank("_k").result()
    if not columns:
        return ranked.select(*K, "metric", F.col("_k").alias("k"), "value")
    return ranked.groupBy(*K, "metric").agg(
        *[F.max(F.when(F.col("_k") == i, F.col("value"))).alias(f"v{i}") for i in range(1, columns + 1)],
        F.count(F.lit(1)).alias("n"))


def is_interesting(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    last = F.regexp_extract(k, r"([^.]*)$", 1)
    prefixed = last.rlike("^(" + "|".join(INTEREST_PREFIXES) + ")")
    return k.isin(*INTEREST) | last.isin(*INTEREST) | prefixed | F.lower(k).contains(INTEREST_TOKEN)


def argument_group(key: str | Column) -> Column:
    last = F.regexp_extract(F.col(key) if isinstance(key, str) else key, r"([^.]*)$", 1)
    return X.first_match((last == "quantization", "quantization"), (last.isin(*PARALLEL_KEYS), "parallel"),
                         (last.isin(*CONFIG_KEYS), "config"), (last.rlike("spec|eagle3"), "speculative"), default="feature")


_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[{}\[\](),:]|[^\s{}\[\](),:'\"]+|['\"]", re.S)
_CLOSES = {"}": "{", "]": "[", ")": "("}


def literal_pairs(text: str | None) -> list[tuple[str, str]]:
    """(dotted key, value text) of the pairs of a Python literal, from inside its outer brace, to any depth.

    A stack of open brackets says where a value ends, so a value that is no literal (a call, a representation) is kept as it
    stands and hides nothing around it. Dictionaries that are values are opened under their key; what is inside lists and calls
    is not. A text that breaks off gives its open values as far as they go. A closing bracket that nothing opened is skipped, one
    that closes an outer bracket closes the inner ones too.
    """
    out: list[tuple[str, str]] = []
    stack = ["{"]
    # open dictionaries: brackets around them, dotted key, key of the pair that is read, its value's start, whether a key may come
    dicts: list[list] = [[1, "", None, None, True]]
    last, end = None, 0

    def close(at: int) -> None:
        d = dicts[-1]
        if d[2] is not None and d[3] is not None:
            out.append((d[2], text[d[3] : at].strip()))
        d[2] = d[3] = None

    for m in _TOKEN.finditer(text or ""):
        token, d = m[0], dicts[-1]
        direct = d[0] == len(stack)
        if token in "{[(":
            opens = token == "{" and direct and d[3] is not None and not text[d[3] : m.start()].strip()
            stack.append(token)
            if opens:
                dicts.append([len(stack), d[2], None, None, True])
        elif token in _CLOSES:
            if _CLOSES[token] in stack:
                while True:
                    if dicts[-1][0] == len(stack):
                        close(m.start())
                        dicts.pop()
                    if stack.pop() == _CLOSES[token]:
                        break
                if not dicts:
                    return [(k, v) for k, v in out if v]
        elif token == "," and direct:
            close(m.start())
            d[4] = True
        elif token == ":" and direct and d[4] and last:
            d[2] = f"{d[1]}.{last}" if d[1] else last
            d[3], d[4] = m.end(), False
        last = token[1:-1] if len(token) > 1 and token[0] in "'\"" else None
        end = m.end()
    while dicts:
        close(end)
        dicts.pop()
    return [(k, v) for k, v in out if v]


def launch_args(lines: DataFrame, K: Sequence[str] = LK, marker: str = "non-default args:") -> DataFrame:
    """(key, value, group) of the first argument line of each log; nested pairs under dotted keys next to their parent."""
    raw = lines.where(F.col("value").contains(marker)).where(
        F.substring_index("value", marker, -1).contains("{")).groupBy(*K).agg(F.min_by("value", "seq").alias("_l"))
    body = F.regexp_extract("_l", marker + r"\s*.*?\{(.*)$", 1)
    q = lambda c: F.regexp_replace(F.trim(c), "^['\"]|['\"]$", "")
    body = F.regexp_replace(F.regexp_replace(body, r'"([\w.\-]+)"\s*:', "'$1':"), r"\bnull\b", "None")
    ship(lines.sparkSession)
    pairs = F.pandas_udf(lambda texts: texts.map(literal_pairs), "array<struct<k: string, v: string>>")
    rows = raw.select(*K, body.alias("_b")).select(*K, F.inline(pairs("_b"))).where(is_interesting("k") & (F.trim("v") != ""))
    return rows.select(*K, F.col("k").alias("key"), q(F.col("v")).alias("value"), argument_group("k").alias("group"))
