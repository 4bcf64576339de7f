"""Run registered queries against their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype).replace("us]", "ns]") for c in sorted(frame.columns)}


def problem(name: str, spark, connection, folder: str) -> str | None:
    """What differs between a query and its SQL, or ``None``."""
    got = contract.queries()[name](spark, folder).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if len(got) else "no rows"
    want = connection.execute(sql).df()
    if not len(want):
        return "the SQL finds no rows"
    if kinds(got) != kinds(want):
        return f"columns {kinds(got)} against {kinds(want)}"
    left, right = rows(got), rows(want)
    if left == right:
        return None
    return (f"{len(got)} rows against {len(want)}; only here {list((left - right).items())[:3]}; "
            f"only in SQL {list((right - left).items())[:3]}")[:1500]


def main() -> None:
    from conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, connection, bad = make_session(), duck(folder), 0
    for name in contract.queries():
        if only and not any(part in name for part in only):
            continue
        begun = time.time()
        try:
            found = problem(name, spark, connection, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:900]}"
        bad += found is not None
        print(f"{time.time() - begun:6.2f}s {name}: {found or 'ok'}", flush=True)
    print(f"{bad} of {len(contract.queries())} differ")


if __name__ == "__main__":
    main()
