"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    """None when the rows agree, else a description of the difference."""
    df = entry.queries()[name](spark, sf_dir)
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if a else "no rows"
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} <> {b_cols}"
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return (f"rows {len(a)} <> {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}")[:900]
    return None


def session():
    from strandline import build_session
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf)
    bad, times = 0, {}
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as e:
            problem = "".join(traceback.format_exception_only(type(e), e))[:700]
        times[name] = time.time() - t
        if os.environ.get("VERBOSE"):
            print(f"{name} {times[name]:.1f}", flush=True)
        if problem:
            bad += 1
            print(f"FAIL {name}: {problem}", flush=True)
    print(f"{len(times) - bad} ok, {bad} failed", flush=True)
    print("slowest", sorted(((round(v, 1), k) for k, v in times.items()), reverse=True)[:12])
    spark.stop()
