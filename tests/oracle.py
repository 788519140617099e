"""Compare registered queries with their SQL.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# limits so low that every group counts as too big and every lookup as too large
TIGHT = {
    "habitspark.window.maxGroupRows": "20",
    "habitspark.broadcast.maxBytes": "1",
    "habitspark.join.salts": "3",
    "habitspark.join.hotKeyRows": "1",
}


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder
    if os.environ.get("TIGHT"):
        for key, value in TIGHT.items():
            builder = builder.config(key, value)
    return (
        builder.master(f"local[{cpus}]")
        .appName("habitspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cur = con.execute(sql)
    theirs_cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    if sorted(theirs_cols) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} vs {sorted(theirs_cols)}"
    if not theirs:
        return len(ours) == 0, "both empty" if not ours else "sql is empty"
    names = sorted(theirs_cols)

    def canon(rows, columns):
        at = [columns.index(n) for n in names]
        return sorted(tuple(normal(r[i]) for i in at) for r in rows)

    a, b = canon(ours, spark_df.columns), canon(theirs, theirs_cols)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {names}\n   {bad[0][0]}\n   {bad[0][1]}"
    return True, f"{len(a)} rows"


def main() -> None:
    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = e.oracle_sql()
    failed = []

    def too_long(*_):
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError("over the limit")

    signal.signal(signal.SIGALRM, too_long)
    for name, fn in e.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "150")))
        try:
            if name in sql:
                ok, text = compare(fn(spark, folder), con, sql[name])
            else:
                ok, text = True, f"rows only: {len(fn(spark, folder).collect())}"
        except Exception as err:  # noqa: BLE001
            ok, text = False, f"{type(err).__name__}: {str(err)[:1500]}"
        signal.alarm(0)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
        spark.catalog.clearCache()
    print(f"{len(failed)} failed: {failed}")
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
