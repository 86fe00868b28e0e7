"""Compare a query's rows with the rows of its SQL in DuckDB.

``python tests/oracle.py [sf_dir] [name ...]`` checks the named (or all) queries and prints times.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), _rows(names, cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    names, got = spark_rows(df)
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        extra = [g for g in got if g not in set(wanted)][:2]
        missing = [w for w in wanted if w not in set(got)][:2]
        return f"{len(got)} rows != {len(wanted)}; extra {extra}; missing {missing}"
    for g, w in zip(got, wanted):
        if g != w:
            return f"row {g} != {w}"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from filemason.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                t0 = time.time()
                wanted = duck_rows(con, sqls[name])
                duck = time.time() - t0
                start = time.time()
                found = difference(query(spark, sf_dir), con, sqls[name])
                rows = len(wanted[1])
            else:
                rows, found, duck = len(query(spark, sf_dir).collect()), None, -1.0
        except Exception as e:  # noqa: BLE001
            rows, found, duck = -1, f"{type(e).__name__}: {str(e)[:1500]}", -1.0
        print(f"{'ok ' if found is None else 'BAD'} {name:28s} rows={rows:6d} {time.time() - start:6.2f}s "
              f"duck={duck:5.2f}s {found or ''}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
