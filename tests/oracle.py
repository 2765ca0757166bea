"""Run named queries and their SQL counterparts side by side: python tests/oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "null" if value != value else repr(value + 0.0)
    if value is None or value is pd.NaT or value is pd.NA:
        return "null"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if hasattr(value, "item"):
        value = value.item()
        return _cell(value) if isinstance(value, float) else str(value)
    return str(value)


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def _kind(dtype) -> str:
    text = str(dtype)
    for kind in ("int", "float", "bool", "datetime"):
        if text.lower().startswith(kind):
            return kind
    return "object"


def compare(result: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(result.columns) != sorted(expected.columns):
        return f"columns {sorted(result.columns)} != {sorted(expected.columns)}"
    if len(result) != len(expected):
        return f"rows {len(result)} != {len(expected)}"
    a, b = canonical(result), canonical(expected)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        lost = [x for x in b if x not in set(a)][:2]
        return f"values differ ({sorted(result.columns)}): spark only {extra} / sql only {lost}"
    kinds = {c: (_kind(result[c].dtype), _kind(expected[c].dtype)) for c in result.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return f"types {odd}" if odd else None


def main(sf_dir: str, names: list[str]) -> int:
    from shoal.plans import load_queries
    from shoal.session import get_session

    queries, oracles = load_queries()
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                               "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            result = frame.toPandas()
            took = time.time() - start
            problem = None
            if name in oracles:
                problem = compare(result, con.execute(oracles[name]).df())
            status = "ok" if problem is None else "DIFFERS"
            status += "" if name in oracles else " (rows only)"
        except Exception as error:  # noqa: BLE001 - a report over many queries
            took, status, problem = time.time() - start, "FAILED", f"{type(error).__name__}: {str(error)[:600]}"
            result = pd.DataFrame()
        bad += problem is not None
        print(f"{name:32s} {took:6.2f}s {len(result):8d} rows  {status} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
