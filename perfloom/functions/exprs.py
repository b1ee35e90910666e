"""Scalar column expressions shared by the operators.  All stay inside JVM code generation; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_contains(text: Column, tokens: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def first_match(*branches: tuple[Column, object], default: object = None) -> Column:
    """Ordered CASE: the value of the first true branch."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Small fixed dimension as a literal map instead of a join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


# ---------------------------------------------------------------- trace events

def to_us(seconds: str | Column) -> Column:
    """Seconds text to whole microseconds (truncated product of the double)."""
    return (_c(seconds).try_cast("double") * 1e6).cast("long")


def attribution_class(cat: str | Column, name: str | Column) -> Column:
    """Cause class of an idle gap from the longest host event; the order of the tests matters."""
    cat, name = _c(cat), F.lower(_c(name))
    # Fixed values: (class, category, name tokens) in priority order.
    table = [
        ("CPU_SCHED", "cpu_sched", ["sched"]),
        ("DATA_LOADER", "data_loader", ["dataloader"]),
        ("MEMCPY", "npu_memcpy", ["memcpy", "copy"]),
        ("LAUNCH_GAP", "cuda_npu_api", ["launch"]),
        ("IO_WAIT", "io", ["io", "read", "write"]),
        ("RUNTIME_BLOCK", "runtime", ["sync", "lock", "mutex"]),
    ]
    return first_match(
        *[((cat == c) | any_contains(name, tokens), label) for label, c, tokens in table], default="OTHER"
    )


def device_category(op_type: str | Column, name: str | Column) -> Column:
    """Category of a device row from its type and name."""
    op_type, name = F.lower(_c(op_type)), F.lower(_c(name))
    return first_match(
        (op_type.contains("memcpy") | name.contains("copy"), "npu_memcpy"),
        (name.contains("sync"), "stream_sync"),
        default="npu_kernel",
    )


def memcpy_direction(direction: str | Column, op: str | Column) -> Column:
    """``H2D``/``D2H`` from a direction text or copy-kind number, else from the op text; '' when unknown."""
    d, o = F.upper(F.coalesce(_c(direction), F.lit(""))), F.upper(F.coalesce(_c(op), F.lit("")))
    return first_match(
        (any_contains(d, ["H2D", "HOST_TO_DEVICE", "HTOD"]), "H2D"),
        (any_contains(d, ["D2H", "DEVICE_TO_HOST", "DTOH"]), "D2H"),
        (d.rlike(r"^1(\.\d*)?$"), "H2D"),
        (d.rlike(r"^2(\.\d*)?$"), "D2H"),
        (any_contains(o, ["H2D", "HTOD"]), "H2D"),
        (any_contains(o, ["D2H", "DTOH"]), "D2H"),
        default="",
    )


def json_id(args: str | Column, first: str, second: str) -> Column:
    """Integer at ``first``, or at ``second`` only when ``first`` is absent; -1 when missing or not a number."""
    a = F.get_json_object(_c(args), f"$.{first}")
    b = F.get_json_object(_c(args), f"$.{second}")
    return F.coalesce(F.when(a.isNotNull(), a.try_cast("double").cast("long")).otherwise(
        b.try_cast("double").cast("long")), F.lit(-1).cast("long"))


def task_name(task_pid: str | Column) -> Column:
    """Part before the last hyphen of TASK-PID, or the whole text when no number follows it."""
    x = _c(task_pid)
    return F.when(x.rlike(r"^.+-\d+$"), F.regexp_extract(x, r"^(.+)-(\d+)$", 1)).otherwise(x)


def task_pid(text: str | Column) -> Column:
    x = _c(text)
    return F.when(x.rlike(r"^.+-\d+$"), F.regexp_extract(x, r"^(.+)-(\d+)$", 2).try_cast("long")).otherwise(
        F.lit(-1).cast("long"))


# ---------------------------------------------------------------- numbers

def safe_div(a: str | Column, b: str | Column, eps: float = 1e-9) -> Column:
    """a/b, or 0 when the denominator is (almost) zero."""
    a, b = _c(a), _c(b)
    return F.when(F.abs(b) < eps, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def ratio(base: str | Column, comp: str | Column) -> Column:
    """comp/base; 1 when both are zero, +inf when only the base is."""
    base, comp = _c(base).cast("double"), _c(comp).cast("double")
    return first_match(
        ((base == 0) & (comp == 0), 1.0),
        (base == 0, float("inf")),
        default=F.try_divide(comp, base),
    )


def tolerant_double(text: str | Column) -> Column:
    """Number text with blanks, '/', '-inf', 'nan' and bad text as 0; 'inf' stays +inf."""
    x = F.lower(F.trim(_c(text)))
    return first_match(
        (x.isin("inf", "+inf", "infinity"), float("inf")),
        (x.isNull() | x.isin("", "/", "-inf", "-infinity", "nan", "none"), 0.0),
        default=F.coalesce(x.try_cast("double"), F.lit(0.0)),
    )


def tolerant_long(text: str | Column) -> Column:
    x = tolerant_double(text)
    return F.when(x == float("inf"), F.lit(0).cast("long")).otherwise(x.try_cast("long"))


def us_to_ms(x: str | Column) -> Column:
    return _c(x).cast("double") / 1000.0


def memory_gb(value: str | Column, unit: str | Column) -> Column:
    """MB/MiB to GB by 1024; GB/GiB unchanged."""
    v = _c(value).try_cast("double")
    return F.when(F.upper(_c(unit)).isin("MB", "MIB"), v / 1024.0).otherwise(v)


def duration_ms(text: str | Column) -> Column:
    """'<50ms', '2 s', '30' -> milliseconds; blank words -> null."""
    x = F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))
    # Words that mean "no limit", and unit words.
    blank = x.isin("", "-", "n/a", "none", "不限", "无", "null")
    y = F.trim(F.regexp_replace(x, "[<≤]=?", ""))
    value = F.regexp_extract(y, r"^([0-9.]+)\s*(ms|s|秒|毫秒)?", 1).try_cast("double")
    unit = F.regexp_extract(y, r"^([0-9.]+)\s*(ms|s|秒|毫秒)?", 2)
    return F.when(blank, None).when(unit.isin("s", "秒"), value * 1000.0).otherwise(value)


def shape_elements(shape: str | Column, largest: bool = False) -> Column:
    """Elements of 'a,b;c,d' tensors: summed, or of the largest one.  A tensor with a non-numeric dimension counts 0."""
    parts = F.split(F.regexp_replace(F.trim(_c(shape)), '^"+|"+$', ""), ";")
    sizes = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(r"^\s*\d+\s*(,\s*\d+\s*)*$"),
            F.aggregate(F.split(p, ","), F.lit(1).cast("long"), lambda acc, d: acc * F.trim(d).try_cast("long")),
        ).otherwise(F.lit(0).cast("long")),
    )
    if largest:
        return F.coalesce(F.array_max(sizes), F.lit(0).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)


def format_count(n: str | Column) -> Column:
    """1234 -> '1.2K', with M and B above; halves round up."""
    n = _c(n).cast("long")

    def short(unit: int, letter: str) -> Column:
        tenths = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(letter))

    return first_match(
        (n >= 10**9, short(10**9, "B")), (n >= 10**6, short(10**6, "M")), (n >= 10**3, short(10**3, "K")),
        default=n.cast("string"),
    )


def count_lines(cell: str | Column) -> Column:
    """Non-blank lines of a cell."""
    return F.size(F.filter(F.split(F.coalesce(_c(cell), F.lit("")), "\n"), lambda x: F.trim(x) != "")).cast("long")


def ratio_band(r: str | Column) -> Column:
    r = _c(r)
    return first_match(
        (r == float("inf"), "new"), (r < 0.1, "extreme_improvement"), (r < 0.9, "improved"),
        (r < 1.0, "slightly_improved"), (r == 1.0, "unchanged"), (r <= 1.05, "slightly_degraded"),
        (r <= 1.10, "degraded"), default="severely_degraded",
    )


# ---------------------------------------------------------------- text and keys

def truncate_display(text: str | Column, limit: int = 120) -> Column:
    x = _c(text)
    return F.when(
        F.length(x) > limit,
        F.concat(F.substring(x, 1, limit), F.lit("... ("), F.length(x).cast("string"), F.lit(" chars)")),
    ).otherwise(x)


def path_section(path: str | Column) -> Column:
    return F.regexp_extract(_c(path), r"^([^.\[]*)", 1)


# Dump section -> category.  Pass your own map for vendor-specific sections.
SECTION_CATEGORIES = {
    "system": "system", "env": "env", "mies config": "config", "user config": "config", "model config": "config",
    "weight": "weight", "ping": "network", "hccl": "network", "link": "network", "vnic": "network", "tls": "network",
    "_meta": "meta",
}


def section_category(section: str | Column, table: Mapping[str, str] = SECTION_CATEGORIES) -> Column:
    return lookup(_c(section), table, "other")


def cell_flag(cell: str | Column) -> Column:
    """Feature cell: tick -> '1', cross -> '0', mark with a note -> the note, '-' or blank -> null."""
    x = F.trim(_c(cell))
    note = F.trim(F.regexp_replace(x, "^[✓✔√✅×✗✘❌]\\s*", ""))
    return first_match(
        (x.isNull() | x.isin("", "-"), F.lit(None).cast("string")),
        (x.rlike("^[✓✔√✅]$"), "1"),
        (x.rlike("^[×✗✘❌]$"), "0"),
        default=note,
    )


def normal_key(text: str | Column) -> Column:
    """Lower case, '_' as '-', without the first 'org/' segment."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), "_", "-"), "^[^/]*/", "")


# Spellings of number formats -> the one the tables use.
PRECISION_ALIASES = {
    "bf16": "bf16", "bfloat16": "bf16", "fp16": "bf16", "w8a8": "w8a8", "w8a8c16": "w8a8", "w8a8c8": "w8a8",
    "w4a8": "w4a8", "w4a8c16": "w4a8", "w4a8c8": "w4a8",
}


def precision_key(text: str | Column, aliases: Mapping[str, str] = PRECISION_ALIASES) -> Column:
    """Letters and digits in lower case, known spellings as one."""
    key = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]", "")
    return F.coalesce(lookup(key, aliases), key)


def scenario_tag(concurrency: str | Column, total_len: str | Column, high: int = 16, long: int = 65536) -> Column:
    return F.concat_ws(
        "+",
        F.when(_c(concurrency) >= high, "high_concurrency").otherwise("low_concurrency"),
        F.when(_c(total_len) >= long, "long_sequence").otherwise("short_sequence"),
    )


def numeric_order(text: str | Column, other: int = 999) -> Column:
    """Sort key of an id kept as text: its number, or ``other``."""
    x = _c(text)
    return F.when(x.rlike(r"^\d+$"), x.try_cast("long")).otherwise(F.lit(other).cast("long"))


def register_functions(spark: SparkSession) -> None:
    """Expose the two most reused expressions to SQL text as session functions."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION attribution_class(cat STRING, name STRING) RETURNS STRING RETURN
        CASE WHEN cat = 'cpu_sched' OR lower(name) LIKE '%sched%' THEN 'CPU_SCHED'
             WHEN cat = 'data_loader' OR lower(name) LIKE '%dataloader%' THEN 'DATA_LOADER'
             WHEN cat = 'npu_memcpy' OR lower(name) LIKE '%copy%' OR lower(name) LIKE '%memcpy%' THEN 'MEMCPY'
             WHEN cat = 'cuda_npu_api' OR lower(name) LIKE '%launch%' THEN 'LAUNCH_GAP'
             WHEN cat = 'io' OR lower(name) RLIKE 'io|read|write' THEN 'IO_WAIT'
             WHEN cat = 'runtime' OR lower(name) RLIKE 'sync|lock|mutex' THEN 'RUNTIME_BLOCK'
             ELSE 'OTHER' END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION shape_elements(shape STRING) RETURNS BIGINT RETURN
        aggregate(split(shape, ';'), 0L, (acc, p) -> acc + CASE WHEN p RLIKE '^ *[0-9]+ *(, *[0-9]+ *)*$'
            THEN aggregate(split(p, ','), 1L, (m, d) -> m * CAST(trim(d) AS BIGINT)) ELSE 0L END)"""
    )
