"""Runs registered queries beside their SQL in DuckDB and compares rows, columns and values.

As a script: ``python tests/oracle.py sf_dir [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from curatrix.plans import derived, registry  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in derived.BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, connection=None, clock: list | None = None) -> str | None:
    """None if both sides agree, else what differs. ``clock`` takes the seconds of both sides."""
    start = time.time()
    frame = registry.queries()[name](spark, sf_dir)
    got = _canonical(frame.columns, [tuple(r) for r in frame.collect()])
    between = time.time()
    result = (connection or connect(sf_dir)).execute(registry.oracle_sql()[name])
    want = _canonical([d[0] for d in result.description], result.fetchall())
    if clock is not None:
        clock += [between - start, time.time() - between]
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return (
        f"rows {len(got[1])} / {len(want[1])}; only Spark {len(extra)}: {sorted(extra)[:2]}; "
        f"only SQL {len(missing)}: {sorted(missing)[:2]}"
    )


def main() -> None:
    from curatrix.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    connection = connect(sf_dir)
    sql = registry.oracle_sql()
    for name in names or registry.queries():
        clock: list[float] = []
        if name in sql:
            try:
                bad = compare(spark, sf_dir, name, connection, clock)
            except Exception as error:  # noqa: BLE001
                bad = f"{type(error).__name__}: {str(error)[:700]}"
        else:
            start = time.time()
            rows = registry.queries()[name](spark, sf_dir).collect()
            print(f"rows {name} {time.time() - start:.1f}s {len(rows)}", flush=True)
            continue
        print(f"{'ok  ' if bad is None else 'DIFF'} {name} {[round(x, 1) for x in clock]} {bad or ''}"[:1500], flush=True)


if __name__ == "__main__":
    main()
