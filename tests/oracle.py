"""Run queries next to their SQL in DuckDB and compare names, row counts and values.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import collections
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when equal, else the first difference found."""
    order = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != order:
        return f"columns {order} != {sorted(names)}"
    index = [names.index(c) for c in order]
    want = collections.Counter(tuple(plain(r[i]) for i in index) for r in result.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"rows {sum(got.values())} / {sum(want.values())}; only here {sum(extra.values())}: {list(extra)[:2]}; "
        f"only in SQL {sum(missing.values())}: {list(missing)[:2]}; columns {order}"
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from taxaflow.session import build_session

    directory, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(directory), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, directory)
            sql = entry.oracle_sql().get(name)
            note = f"rows only {df.count()}" if sql is None else compare(df, con, sql)
            ok = sql is None or note is None
        except Exception as error:  # noqa: BLE001
            note, ok = f"{type(error).__name__}: {str(error)[:600]}", False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
