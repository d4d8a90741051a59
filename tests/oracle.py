"""Run registered queries against their SQL counterparts: python tests/oracle.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rows = df.collect()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    kinds = [str(c[1]) for c in cur.description]
    theirs = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(rows) != len(theirs):
        return f"rows {len(rows)} vs {len(theirs)}"
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        want = kinds[cols.index(name)]
        if expected.get(kind, kind) != want:
            return f"type of {name}: {kind} vs {want}"
    order = sorted(df.columns)
    mine = sorted(tuple(_cell(r[c]) for c in order) for r in rows)
    other = sorted(tuple(_cell(r[cols.index(c)]) for c in order) for r in theirs)
    for a, b in zip(mine, other):
        if a != b:
            return f"values {order}: {a} vs {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from palinode.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = oracle_sql()
    for name, fn in queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            if name in sqls:
                diff = compare(fn(spark, sf_dir), con, sqls[name])
                n = ""
            else:
                diff, n = None, f"rows={fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {time.time() - t:6.2f}s {name} {n}{diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
