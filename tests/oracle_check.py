"""Run registered queries and their SQL on the same tables and compare rows. Usable as a script."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a text that says what differs."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if got == want:
        types = {c: t for c, t in df.dtypes}
        whole = {d[0] for d in result.description if str(d[1]) == "INTEGER"}
        odd = [c for c, t in types.items() if (t == "int" and c not in whole) or t == "decimal" or t.startswith("array") or t.startswith("struct")]
        return f"types {odd}" if odd else None
    return f"{sum(got.values())} vs {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"


if __name__ == "__main__":
    from rosterlens.plans.catalog import QUERIES
    from rosterlens.plans.oracle import ORACLE
    from rosterlens.session import local_session

    sf = sys.argv[1]
    spark, con = local_session("check", 8, 8), duck(sf)
    spark.sparkContext.setLogLevel("OFF")
    for n in sys.argv[2:] or ORACLE:
        t = time.time()
        try:
            bad = compare(spark, con, sf, n, QUERIES[n], ORACLE[n])
        except Exception as e:  # noqa: BLE001
            bad = f"ERROR {str(e)[:500]}"
        print(f"{'ok ' if bad is None else 'BAD'} {n} {time.time() - t:.1f}s {bad or ''}", flush=True)
