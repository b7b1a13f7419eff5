"""Run queries on Spark and their SQL on DuckDB, and compare the rows without regard to order."""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(directory):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, build, sql, directory):
    """(problem or None, rows, Spark seconds, SQL seconds)."""
    begin = time.time()
    df = build(spark, directory)
    got = [tuple(r) for r in df.collect()]
    middle = time.time()
    names = df.columns
    if sql is None:
        return None, len(got), middle - begin, 0.0
    result = db.execute(sql)
    expected_names = [d[0] for d in result.description]
    expected = result.fetchall()
    end = time.time()
    problem = None
    if sorted(names) != sorted(expected_names):
        problem = f"columns {sorted(names)} != {sorted(expected_names)}"
    elif len(got) != len(expected):
        problem = f"{len(got)} rows, expected {len(expected)}"
    else:
        for a, b in zip(_rows(names, got), _rows(expected_names, expected)):
            if a != b or [type(x) for x in a] != [type(x) for x in b]:
                problem = f"{a!r:.300} != {b!r:.300}"
                break
    return problem, len(got), middle - begin, end - middle


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    directory, wanted = sys.argv[1], sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(directory)
    failed = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, spark_s, sql_s = compare(session, database, build, entry.oracle_sql().get(name), directory)
        except Exception as exc:
            problem, n, spark_s, sql_s = f"{type(exc).__name__}: {exc}"[:1200], -1, 0, 0
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:24s} rows={n:<7d} spark={spark_s:.2f}s sql={sql_s:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
