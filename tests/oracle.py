"""Run a registered query and its SQL on the same tables and compare schema and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

import __spark_entry__ as E

FAMILIES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, sf_dir: str, key: str) -> list[str]:
    """Differences found; empty when the query and its SQL agree."""
    df = E.queries()[key](spark, sf_dir)
    rows = df.collect()
    sql = E.oracle_sql().get(key)
    if sql is None:
        return [] if rows else ["no rows"]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for c, t in df.dtypes:
        if FAMILIES.get(t, t) != types[c].upper():
            problems.append(f"type of {c}: {t} against {types[c]}")
    order = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in order) for r in expected), key=repr)
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    if not want:
        problems.append("no rows to compare")
    if got != want:
        got_set, want_set = set(got), set(want)
        only_got = [r for r in got if r not in want_set][:3]
        only_want = [r for r in want if r not in got_set][:3]
        problems.append(f"{order}: only here {only_got}; only in SQL {only_want}")
    return problems


def main() -> None:
    import sys
    import time

    from plumbline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(E.queries())
    con = connect(sf_dir)
    bad = 0
    for key in E.queries():
        if not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problems = compare(spark, con, sf_dir, key)
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        mark = "ok " if not problems else "BAD"
        bad += bool(problems)
        kind = "sql" if key in E.oracle_sql() else "rows"
        print(f"{mark} {kind} {key} {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
