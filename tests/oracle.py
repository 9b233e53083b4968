"""Compare a Spark result with the checking engine's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

from sparkprep.fixtures import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, connection, sql):
    result = connection.execute(sql)
    wanted_names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(wanted_names):
        return f"columns {sorted(df.columns)} != {sorted(wanted_names)}"
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    wanted = rows_of(wanted_names, result.fetchall())
    if found != wanted:
        extra, lacking = found - wanted, wanted - found
        return (
            f"{sum(extra.values())} rows too many, {sum(lacking.values())} lacking: "
            f"{list(extra)[:2]} / {list(lacking)[:2]}"
        )
    return None
