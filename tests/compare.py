"""Run catalog queries next to their SQL in DuckDB and compare all rows.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(column):
            column = column.map(lambda v: "NULL" if pd.isna(v) else repr(float(v)))
        elif pd.api.types.is_integer_dtype(column):
            column = column.map(lambda v: "NULL" if pd.isna(v) else repr(float(v)))
        frame[name] = column.map(lambda v: "NULL" if v is None or v is pd.NaT or v == "NaT" or v is pd.NA else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}\n{a.head(3)}\n{b.head(3)}"
    for name in a.columns:
        bad = a[name] != b[name]
        if bad.any():
            i = bad.idxmax()
            return f"{name}: {int(bad.sum())} differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, oracles, failed = connect(folder), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            mine = run(spark, folder).toPandas()
            spent = time.time() - started
            if name not in oracles:
                print(f"{name:32} {spent:6.1f}s rows={len(mine)} (no SQL)", flush=True)
                continue
            started = time.time()
            problem = compare(mine, con.execute(oracles[name]).df())
            print(f"{name:32} {spent:6.1f}s sql {time.time() - started:5.1f}s rows={len(mine)} {problem or 'ok'}", flush=True)
        except Exception as err:
            problem = str(err)[:700]
            print(f"{name:32} FAILED {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
