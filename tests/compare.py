"""Run queries in Spark and their SQL in DuckDB and compare all rows, values and column names.

``python tests/compare.py sf0.01 [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LAST = {"ours": 0.0}


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0))
    if isinstance(v, int):
        return (2, repr(float(v)))
    if isinstance(v, (list, tuple)):
        return (3, str([plain(x) for x in v]))
    return (4, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """Empty text when equal, else what differs."""
    got_df = query(spark, sf_dir)
    got = rows_of(got_df.columns, [tuple(r) for r in got_df.collect()])
    LAST["ours"] = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; ours only {_only(got[1], want[1])}; theirs only {_only(want[1], got[1])}", len(got[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ; ours {_only(got[1], want[1])}; theirs {_only(want[1], got[1])}", len(got[1])
    return "", len(got[1])


def _only(a, b):
    seen = set(b)
    return [tuple(x[1] for x in r) for r in a if r not in seen][:3]


def main(argv):
    from tests.session import local_session

    sf = argv[0] if argv else "sf0.01"
    parts = argv[1:]
    import __spark_entry__ as entry

    spark = local_session()
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if parts and not any(name == p or name.startswith(p + "_") for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                text, n = compare(spark, con, sf_dir, q, sql[name])
                mark = "equal" if not text else "DIFFERS"
            else:
                text, n, mark = "", len(q(spark, sf_dir).collect()), "rows"
        except Exception as e:  # report and go on
            text, n, mark = f"{type(e).__name__}: {str(e)[:1500]}", -1, "FAILED"
        bad += mark in ("DIFFERS", "FAILED")
        print(f"{mark:8} {name:28} rows={n:7d} {(LAST["ours"] if name in sql else time.time()) - start:6.2f}s of {time.time() - start:6.2f}s {text[:1800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
