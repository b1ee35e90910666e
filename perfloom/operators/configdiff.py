"""Configuration and environment dumps: flatten, N-way diff, two-node diff, health checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfloom.functions import exprs as X
from perfloom.shared import ship


def parse_json_tolerant(text: str | Column) -> Column:
    """Variant of a dump text; on failure stray ``\\_`` and ``\\:`` escapes and blank lines are repaired first."""
    c = F.col(text) if isinstance(text, str) else text
    fixed = F.replace(F.replace(c, F.lit("\\_"), F.lit("_")), F.lit("\\:"), F.lit(":"))
    packed = F.regexp_replace(fixed, r"\n\s*\n", "\n")
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(fixed), F.try_parse_json(packed))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)


def _text(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def flatten_text(text: str | None, keep_parents: bool = False) -> list[tuple[str, str | None]]:
    """(path, value) per leaf of a JSON text, by its tokens and a stack of open containers, to any depth."""
    if text is None:
        return [("", None)]
    out: list = []
    stack: list[list] = []  # path, is an object, number of the item, has items, where it starts, place of its own row
    key = None

    def here() -> str:
        if not stack:
            return ""
        top = stack[-1]
        top[3] = True
        return f"{top[0]}[{top[2]}]" if not top[1] else f"{top[0]}.{key}" if top[0] else key or ""

    for m in _TOKEN.finditer(text):
        token = m[0]
        c = token[0]
        if c in "{[":
            stack.append([here(), c == "{", 0, False, m.start(), len(out)])
            key = None
            if keep_parents and stack[-1][0]:
                out.append(None)
        elif c in "}]":
            if stack:
                path, _, _, some, start, place = stack.pop()
                if keep_parents and path:
                    out[place] = (path, text[start : m.end()])
                elif not some:
                    out.append((path, text[start : m.end()]))
        elif c == ",":
            if stack:
                stack[-1][2] += 1
        elif c == '"' and stack and stack[-1][1] and key is None:
            key = _text(token)
        elif c != ":":
            out.append((here(), _text(token) if c == '"' else None if token == "null" else token))
            key = None
    return [row for row in out if row]


def json_flatten(df: DataFrame, col: str, K: Sequence[str], keep_parents: bool = False) -> DataFrame:
    """(path, value) per leaf of a variant or JSON text column: ``a.b[0].c``; empty containers stay as ``{}`` and ``[]``.

    One pass over the tokens of each document, so the plan is the same for any depth.  Numbers of a text stay as they are
    written; a null document gives one row with an empty path.  ``keep_parents`` also lists containers.
    """
    ship(df.sparkSession)
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    rows = df.select(*K, (F.col(col) if is_text else F.to_json(col)).alias("_text"))
    schema = T.StructType([*(rows.schema[k] for k in K), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, values = [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                leaves = flatten_text(text, keep_parents)
                at += [i] * len(leaves)
                paths += [p for p, _ in leaves]
                values += [v for _, v in leaves]
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in K]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(paths, pa.string()), pa.array(values, pa.string())], [*K, "path", "value"])

    return rows.mapInArrow(run, schema)


def nway_diff(paths: DataFrame, dump_col: str, dumps: Sequence[str], K: Sequence[str] = (),
              sections: Mapping[str, str] = X.SECTION_CATEGORIES) -> DataFrame:
    """One row per path over all dumps: how many values, where present, where absent, its class.

    A null value and a missing path count the same.  ``_meta`` paths are left out.  Every dump is one conditional
    aggregate, so N dumps cost one shuffle.
    """
    rows = paths.where(~F.col("path").startswith("_meta"))
    # conditional maxima by dump position; `dumps` is the list being compared
    per = rows.groupBy(*K, "path").agg(*[
        F.max(F.when(F.col(dump_col) == d, F.col("value"))).alias(f"_d{i}") for i, d in enumerate(dumps)])
    vals = F.array(*[F.col(f"_d{i}") for i in range(len(dumps))])
    present = F.concat_ws(",", *[F.when(F.col(f"_d{i}").isNotNull(), F.lit(str(d))) for i, d in enumerate(dumps)])
    absent = F.concat_ws(",", *[F.when(F.col(f"_d{i}").isNull(), F.lit(str(d))) for i, d in enumerate(dumps)])
    n = F.size(F.array_distinct(vals)).cast("long")
    kind = F.when(n == 1, "identical").when(absent != "", "only_in").otherwise("modified")
    section = X.path_section("path")
    return per.select(*K, "path", section.alias("section"), X.section_category(section, sections).alias("category"),
                      kind.alias("kind"), n.alias("n_values"), present.alias("present_in"), absent.alias("absent_in"))


def similarity(diff: DataFrame, K: Sequence[str] = ()) -> DataFrame:
    same = F.count_if(F.col("kind") == "identical")
    return diff.groupBy(*K).agg(F.count(F.lit(1)).alias("total"), same.alias("identical"),
                                (F.try_divide(same * 100.0, F.count(F.lit(1)))).alias("similarity_pct"))


def section_stats(diff: DataFrame, K: Sequence[str] = ()) -> DataFrame:
    same = F.count_if(F.col("kind") == "identical")
    return diff.groupBy(*K, "section").agg(F.count(F.lit(1)).alias("total"), same.alias("identical"),
                                           (F.count(F.lit(1)) - same).alias("different"))


def config_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Keys on one side only and keys whose values differ."""
    both = a.select(*keys, F.col("value").alias("_v"), F.lit(0).alias("_s")).unionByName(
        b.select(*keys, F.col("value").alias("_v"), F.lit(1).alias("_s")))
    per = both.groupBy(*keys).agg(
        F.max(F.when(F.col("_s") == 0, F.col("_v"))).alias("value_a"), F.max(F.when(F.col("_s") == 1, F.col("_v"))).alias("value_b"),
        F.bool_or(F.col("_s") == 0).alias("_a"), F.bool_or(F.col("_s") == 1).alias("_b"))
    kind = F.when(~F.col("_b"), "only_in_a").when(~F.col("_a"), "only_in_b").when(
        ~F.col("value_a").eqNullSafe(F.col("value_b")), "value_mismatch")
    return per.select(*keys, kind.alias("kind"), "value_a", "value_b").where("kind is not null")


def line_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), line: str = "line") -> DataFrame:
    """Lines (with multiplicity) that one side has more often than the other."""
    both = a.select(*keys, line, F.lit(1).alias("_n")).unionByName(b.select(*keys, line, F.lit(-1).alias("_n")))
    net = both.groupBy(*keys, line).agg(F.sum("_n").alias("_net")).where("_net <> 0")
    return net.select(*keys, line, F.when(F.col("_net") > 0, "a").otherwise("b").alias("side"), F.abs("_net").alias("n"))


def key_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


# System checks (path, regex of a good value, severity when not good).
SYSTEM_CHECKS = (
    ("system.high_performance", "^true$", "problem"), ("system.virtual_machine", "^false$", "notice"),
    ("system.transparent_hugepage", "^always$", "warning"), ("system.overcommit_memory", "^[01]$", "problem"),
    ("system.page_size", "^4096$", "notice"),
)
# Variables whose absence is reported, and name endings that look like secrets.
CRITICAL_VARS = ("LD_LIBRARY_PATH", "ATB_HOME_PATH", "ATB_SPEED_HOME_PATH", "HCCL_BUFFSIZE", "TASK_QUEUE_ENABLE", "RANK_TABLE_FILE",
                 "OMP_NUM_THREADS", "PYTORCH_NPU_ALLOC_CONF")
SECRET_NAME = r"(_API_KEY|_SECRET|_TOKEN|_PASSWORD)$"
OPTIONAL_SECTIONS = ("mies config", "user config", "model config", "weight", "ping", "hccl", "link", "vnic", "tls")
NETWORK_CHECKS = (("ping", r"(^|[^0-9])0% packet loss"), ("link", "link status: UP"), ("hccl", "3 received"),
                  ("tls", r"tls switch\[0\]\D*0"))


def env_health(paths: DataFrame, K: Sequence[str] = ("dump_id",), system_checks=SYSTEM_CHECKS,
               critical_vars: Sequence[str] = CRITICAL_VARS, network_checks=NETWORK_CHECKS,
               sections: Sequence[str] = OPTIONAL_SECTIONS, env_prefix: str = "env.") -> DataFrame:
    """Findings per dump: (check, subject, status, value).

    One pass and one shuffle: fixed questions are conditional aggregates per dump, open ones (secret-looking names, failing
    network text, release candidates) are tested on each row and gathered with them, as few rows fail one.
    """
    p, v = F.col("path"), F.lower("value")
    asks = {f"_c{i}": F.max(F.when(p == path, v)) for i, (path, _, _) in enumerate(system_checks)}
    asks |= {f"_v{i}": F.bool_or(p == env_prefix + name) for i, name in enumerate(critical_vars)}
    asks |= {f"_s{i}": F.bool_or(X.path_section("path") == s) for i, s in enumerate(sections)}
    none = F.lit(None).cast("string")

    def found(test, check, status):
        return F.when(test, F.struct(F.lit(check).alias("check"), p.alias("subject"), F.lit(status).alias("status"), none.alias("value")))

    version = p.endswith(".version")
    tests = [found(p.startswith(env_prefix) & p.rlike(SECRET_NAME), "secret_name", "problem"),
             found(version & v.rlike("rc[0-9]"), "release_candidate", "notice"),
             found(version & (F.coalesce(v, F.lit("")) == ""), "version", "missing")]
    tests += [found((X.path_section("path") == s) & ~F.coalesce(F.col("value"), F.lit("")).rlike(good), f"network_{s}", "problem")
              for s, good in network_checks]
    failed = F.array_compact(F.array(*tests))
    asks["_open"] = F.flatten(F.collect_list(F.when(F.size(failed) > 0, failed)))
    one = paths.groupBy(*K).agg(*[c.alias(n) for n, c in asks.items()])

    def row(check, subject, status, value):
        return F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), status.alias("status"),
                        value.alias("value"))

    rows = [row("system", path, F.when(F.col(f"_c{i}").isNull(), "missing").when(F.col(f"_c{i}").rlike(good), "ok").otherwise(bad),
                F.col(f"_c{i}")) for i, (path, good, bad) in enumerate(system_checks)]
    rows += [row("variable", n, F.when(F.col(f"_v{i}"), "ok").otherwise("missing"), none) for i, n in enumerate(critical_vars)]
    rows += [row("section", s, F.when(F.col(f"_s{i}"), "ok").otherwise("missing"), none) for i, s in enumerate(sections)]
    return one.select(*K, F.inline(F.concat(F.array(*rows), "_open"))).where("status <> 'ok'")


def component_consistency(paths: DataFrame, left: str, right: str, K: Sequence[str] = ("dump_id",)) -> DataFrame:
    """Whether two components of a dump carry the same release series (the ``8.2.RC1`` of ``8.2.0 (8.2.RC1)``)."""
    series = F.coalesce(F.nullif(F.regexp_extract("value", r"\(([^)]+)\)", 1), F.lit("")), F.col("value"))
    one = paths.groupBy(*K).agg(F.max(F.when(F.col("path") == left, series)).alias("left_series"),
                                F.max(F.when(F.col("path") == right, series)).alias("right_series"))
    return one.withColumn("consistent", F.col("left_series").eqNullSafe(F.col("right_series")))
