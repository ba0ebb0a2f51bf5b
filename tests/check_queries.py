"""Run registered queries beside their SQL and compare whole results.

Usage: python tests/check_queries.py [name-substring ...]   (CHECK_SF_DIR picks the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def canon(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return f"{kind(v)}:{v}"


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    cols = sorted(names)
    gi, wi = [spark_df.columns.index(c) for c in cols], [names.index(c) for c in cols]
    g = sorted(tuple(canon(r[i]) for i in gi) for r in got)
    w = sorted(tuple(canon(r[i]) for i in wi) for r in want)
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    if not g:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    return f"{len(bad)} of {len(g)} rows differ, e.g. {cols} {bad[0][0]} != {bad[0][1]}" if bad else None


def main() -> int:
    from karyospark.plans.catalogue import CATALOGUE
    from karyospark.session import local_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in CATALOGUE.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql:
                bad = compare(df, con, q.sql)
                note = "ok" if bad is None else "DIFF " + bad
            else:
                n = len(df.collect())
                bad = None if n else "empty"
                note = f"rows={n}"
        except Exception as e:  # noqa: BLE001
            bad, note = "error", "ERROR " + str(e)[:600].replace("\n", " ")
        failed += bad is not None
        print(f"{name:45s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
