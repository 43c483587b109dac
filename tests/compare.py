"""Run named queries in Spark and in DuckDB and report differences.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry_module  # noqa: E402
from wafermill.catalog.adapters import TABLES  # noqa: E402


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry_module.queries()[name](spark, sf_dir)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = table(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; spark only {len(extra)}: {sorted(map(str, extra))[:2]}; "
            f"duck only {len(missing)}: {sorted(map(str, missing))[:2]}"
        )
    types = {c: t for c, t in df.dtypes}
    duck_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{types[c]}/{duck_types[c]}" for c in types if types[c] in pairs and pairs[types[c]] != duck_types[c]]
    if odd:
        return "types " + ", ".join(odd)
    if not got:
        return "empty result"
    return None


def main() -> int:
    from wafermill.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck_connection(sf_dir)
    all_names = list(entry_module.queries())
    names = [n for n in all_names if not args or any(n == a or n.startswith(a + "*") or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    if args and args[0].startswith("@"):
        wanted = {a[1:] for a in args}
        names = [n for n in all_names if entry_module.queries()[n].__module__.rsplit(".", 1)[-1] in wanted]
    bad = 0
    for n in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, n)
        except Exception as error:  # report and go on with the rest
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        note = "" if n in entry_module.oracle_sql() else " (rows only)"
        print(f"{'ok  ' if problem is None else 'BAD '} {n}{note} {took:.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
