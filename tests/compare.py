"""Run queries against their DuckDB oracles: python tests/compare.py [sf_dir] [query ...]"""

import os
import sys
import time
from collections import Counter
from glob import glob

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(row[i] for i in order) for row in rows]


def differences(spark, con, name, sf_dir, df=None):
    """None when equal, else a short description; and the number of rows."""
    df = queries()[name](spark, sf_dir) if df is None else df
    columns, got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    relation = con.sql(sql)
    wanted_columns, wanted = sorted_rows(list(relation.columns), relation.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", len(got)
    extra, missing = Counter(got) - Counter(wanted), Counter(wanted) - Counter(got)
    if extra or missing:
        return f"{len(got)} vs {len(wanted)} rows; extra {sum(extra.values())}: {list(extra)[:2]}; missing {sum(missing.values())}: {list(missing)[:2]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from sitefold.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session = build_session("local[8]", "compare", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for query in sys.argv[2:] or list(queries()):
        start = time.time()
        try:
            problem, count = differences(session, con, query, folder)
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", -1
        print(f"{'ok  ' if problem is None else 'FAIL'} {query} rows={count} {time.time() - start:.1f}s {(problem or '')[:1500]}", flush=True)
