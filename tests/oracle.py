"""Runs registered queries against their SQL in DuckDB and compares schema, row count and values.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


KINDS = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean",
         "timestamp": "timestamp", "float": "float", "date": "date"}


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    """None if equal, else what differs."""
    got = fn(spark, sf)
    cols = sorted(got.columns)
    types = {c: KINDS.get(t, t) for c, t in got.dtypes}
    rows = sorted(tuple(_norm(v) for v in r) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in want)
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    bad = [c for c in cols if types[c] != kinds[c].replace("timestamp_ns", "timestamp")]
    if bad:
        return f"types {[(c, types[c], kinds[c]) for c in bad]}"
    for a, b in zip(rows, want):
        if a != b:
            return f"values {dict(zip(cols, a))} != {dict(zip(cols, b))}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("oracle", "local[8]", 8, {"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], sf)
                kind = "oracle"
            else:
                problem, kind = None, f"{fn(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            problem, kind = f"{type(e).__name__}: {str(e)[:600]}", "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
