"""Run registered queries against the oracle database and print mismatches: python -m tests.check [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else (v if math.isinf(v) else float(f"{v:.12g}"))
    return v


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    rows = spark_df.collect()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order = sorted(names)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in rows), key=repr)
    idx = [names.index(c) for c in order]
    exp = sorted((tuple(_norm(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in idx) for r in want), key=repr)
    if len(got) != len(exp):
        return f"rows {len(got)} vs {len(exp)}; e.g. {[x for x in got if x not in set(exp)][:2]} / {[x for x in exp if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, exp) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {order}: {bad[0]}"
    kinds = {c: type(r).__name__ for row in rows[:1] for c, r in row.asDict().items()}
    odd = [n for n, t in zip(names, types) if ("DECIMAL" in t or "HUGEINT" in t) and kinds.get(n) is not None]
    return f"types of {odd} in the oracle are not BIGINT/DOUBLE" if odd else None


def main() -> None:
    import __spark_entry__ as E
    from tests.conftest import make_session

    args = sys.argv[1:]
    if "--split" in args:       # force the skew path on every ordered operator
        args.remove("--split")
        from perfloom.operators import sequence

        sequence.SPLIT_ROWS = 40
    sf = args.pop(0) if args and args[0].startswith("0") else "0.01"
    d = f"/root/testdata/sf{sf}"
    spark, con = make_session(), oracle_connection(d)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in args or qs:
        t = time.time()
        try:
            df = qs[name](spark, d)
            msg = compare(df, con, os_[name]) if name in os_ else f"(no oracle) {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        if msg and not msg.startswith("(no"):
            bad += 1
        if msg:
            print(f"{name:24s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(args or qs)} queries, {bad} bad")


if __name__ == "__main__":
    main()
