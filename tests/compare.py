"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))


def connected(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    from quillon.sources.tables import TABLES

    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return ("f", None if math.isnan(x) else round(x, 6) + 0.0)
    if isinstance(x, bool) or x is None:
        return ("b", x)
    return (type(x).__name__[0], x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


def differs(spark, con, run, sql, sf_dir):
    """None, or what differs."""
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only ours {only[0]}; only SQL's {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quillon.session import session

    spark = session(**{"spark_master": "local[8]", "spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, con, sqls = sys.argv[1], connected(sys.argv[1]), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sqls:
        t = time.time()
        try:
            what = differs(spark, con, entry.queries()[name], sqls[name], sf)
        except Exception:
            what = traceback.format_exc()[-900:]
        bad += what is not None
        if what or time.time() - t > 4:
            print(f"{name}: {what or 'same'} ({time.time() - t:.1f} s)", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or sqls)} differ")
