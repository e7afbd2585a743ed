"""Run registered queries beside their SQL in DuckDB and compare rows.

Usage: python tests/check_queries.py [--sf 0.01] [name ...]
"""

import argparse
import datetime
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("auditlake-check")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "10g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, sf_dir, db):
    started = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_sec = time.time() - started
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL ({spark_sec:.1f}s)", True
    started = time.time()
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    sql_sec = time.time() - started
    same = sorted(columns) == sorted(df.columns) and got == want
    text = f"{name}: {len(got)} / {len(want)} rows ({spark_sec:.1f}s / {sql_sec:.1f}s) {'ok' if same else 'DIFFERENT'}"
    if not same:
        text += f"\n  columns {sorted(df.columns)} / {sorted(columns)}"
        extra, missing = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        text += "".join(f"\n  only Spark: {r[:400]}" for r in sorted(extra)[:4])
        text += "".join(f"\n  only SQL:   {r[:400]}" for r in sorted(missing)[:4])
    return text, same


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    spark = session()
    failed = []
    for name in args.names or contract.queries():
        try:
            text, same = compare(spark, name, sf_dir, db)
        except Exception as err:  # report and go on to the next query
            text, same = f"{name}: ERROR {type(err).__name__}: {str(err)[:1500]}", False
        print(text, flush=True)
        if not same:
            failed.append(name)
    print(f"{len(failed)} different: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
