"""Run registered queries beside their SQL in DuckDB and compare all values.

    python tests/check_oracles.py [sf_dir] [name …]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(map(str, r)))


def compare(df, con, sql):
    """(equal, text): the text says what differs first."""
    cols, got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != names:
        return False, f"columns {cols} / {names}"
    if len(got) != len(want):
        return False, f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            diff = {c: (x, y) for c, x, y in zip(cols, a, b) if x != y}
            return False, f"{sum(x != y for x, y in zip(got, want))} differ; {a[:2]} {diff}"
    return True, f"{len(got)} rows"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from logfathom.session import builder

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(queries())
    spark = (
        builder().master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            if name in oracle_sql():
                ok, text = compare(df, con, oracle_sql()[name])
            else:
                ok, text = True, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report every query, not just the first failure
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {text}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
