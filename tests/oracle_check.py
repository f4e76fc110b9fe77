"""Run registered queries on Spark and on DuckDB and compare the results value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    return str(value)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, int]:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = _normal(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _normal(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if got == want:
        return True, "match", len(got)
    have, expected = set(got), set(want)
    extra = [r for r in got if r not in expected][:3]
    missing = [r for r in want if r not in have][:3]
    return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only duckdb {missing}", len(got)


def main(argv: list[str]) -> None:
    import __spark_entry__ as entry
    from codelode.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("-")]
    areas = {fn.__module__.rsplit(".", 1)[-1]: None for fn in entry.queries().values()}
    names = [
        n
        for n, fn in entry.queries().items()
        if not wanted or n in wanted or fn.__module__.rsplit(".", 1)[-1] in [w for w in wanted if w in areas]
    ]
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note, n = compare(spark, con, name, sf_dir)
        except Exception as ex:  # report every query, not only the first that fails
            ok, note, n = False, f"{type(ex).__name__}: {str(ex)[:600]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} rows={n:<8d} {time.time() - start:6.2f}s {'' if note == 'match' else note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main(sys.argv[1:])
