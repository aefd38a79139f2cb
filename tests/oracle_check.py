"""Run registered queries against their DuckDB counterparts, value by value.

    python tests/oracle_check.py [--sf sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    """Comparable form of a cell; no tolerance is applied to numbers."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, str)):
        return f"{type(value).__name__}:{value}"
    if isinstance(value, decimal.Decimal):
        return f"dec:{value.normalize()}"
    if isinstance(value, datetime.datetime):
        return f"ts:{value.isoformat()}"
    if isinstance(value, datetime.date):
        return f"date:{value.isoformat()}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, build, sql, sf_dir):
    df = build(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return False, f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    left, right = rows_of(df.columns, ours), rows_of(theirs_columns, theirs)
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return False, f"columns {sorted(df.columns)}\n   spark  {a}\n   duckdb {b}"
    return True, f"{len(left)} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from spindrift.registry import ORACLES, QUERIES
    from spindrift.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/{args.sf}"
    con = duck(sf_dir)
    bad = 0
    for name, build in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, build, ORACLES[name], sf_dir)
            else:
                ok, note = True, f"{build(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:400]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:38s} {time.time() - start:6.2f}s {note}", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
