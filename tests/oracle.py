"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


SPARK_KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """A description of the difference, None when the results agree."""
    result = con.execute(sql)
    expected_types = {column[0]: str(column[1]) for column in result.description}
    actual_types = {name: SPARK_KIND.get(kind, kind) for name, kind in df.dtypes}
    if set(expected_types) != set(actual_types):
        return f"columns {sorted(actual_types)} vs {sorted(expected_types)}"
    expected = bag(list(expected_types), result.fetchall())
    actual = bag(df.columns, df.collect())
    notes = []
    if expected != actual:
        extra, lacking = actual - expected, expected - actual
        notes.append(
            f"rows {sum(actual.values())} vs {sum(expected.values())}; only spark {list(extra.items())[:2]}; "
            f"only sql {list(lacking.items())[:2]} ({sum(extra.values())}/{sum(lacking.values())})"
        )
    off = {n: (actual_types[n], expected_types[n]) for n in actual_types if actual_types[n] != expected_types[n]}
    if off:
        notes.append(f"types {off}")
    return "; ".join(notes) or None


def main() -> int:
    import __spark_entry__ as contract
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    failures = 0
    for name, function in contract.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = function(spark, sf_dir)
            sql = contract.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {df.count()}"
                bad = False
            else:
                difference = compare(df, con, sql)
                verdict, bad = difference or "ok", difference is not None
        except Exception as error:  # report and go on with the next query
            verdict, bad = f"{type(error).__name__}: {str(error)[:600]}", True
        failures += bad
        print(f"{'FAIL' if bad else 'pass'} {name} {time.time() - started:.2f}s {verdict}", flush=True)
    print(f"{failures} failures")
    spark.stop()
    return failures


if __name__ == "__main__":
    sys.exit(main() > 0)
