"""Compare registered queries with their SQL: ``python -m fleet.check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

from fleet.inputs import TABLES
from fleet.registry import ORACLES, QUERIES


def load_all() -> None:
    import fleet.column_queries  # noqa: F401
    import fleet.drift_queries  # noqa: F401
    import fleet.signal_queries  # noqa: F401


def duckdb_over(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL"
    rel = con.sql(ORACLES[name])
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {c: (str(t), df.schema[c].dataType.simpleString()) for c, t in zip(rel.columns, rel.types)}
    same = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    odd = {c: t for c, t in types.items() if same.get(t[0]) != t[1]}
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else []
        only_want = [r for r in want if r not in set(got)][:3] if len(got) < 200_000 else []
        return False, f"{len(got)} rows != {len(want)}; only Spark {only_got}; only SQL {only_want}"
    return True, f"{len(got)} rows" + (f"; types differ: {odd}" if odd else "")


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_over(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main())
