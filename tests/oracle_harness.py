"""Run registered queries against their DuckDB oracles (like the driver's check).

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    from markscope.sources.tables import TABLES
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, oracle, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    srows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()]
    t1 = time.time()
    if oracle is None:
        return dict(name=name, rows=len(srows), oracle=False, spark_sec=round(t1 - t0, 2))
    rel = con.sql(oracle)
    dcols = rel.columns
    drows = [tuple(_norm(dict(zip(dcols, r))[c]) for c in sorted(dcols)) for r in rel.fetchall()]
    ok_cols = sorted(cols) == sorted(dcols)
    cs, cd = collections.Counter(map(repr, srows)), collections.Counter(map(repr, drows))
    res = dict(name=name, rows=len(srows), oracle_rows=len(drows), cols_ok=ok_cols,
               match=ok_cols and cs == cd, spark_sec=round(t1 - t0, 2))
    if not res["match"]:
        res["spark_only"] = list((cs - cd).elements())[:3]
        res["oracle_only"] = list((cd - cs).elements())[:3]
        if not ok_cols:
            res["spark_cols"], res["oracle_cols"] = sorted(cols), sorted(dcols)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from markscope.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_con(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], orc.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, error=str(e)[:1500])
        if not r.get("match", r.get("oracle") is False):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} not ok")


if __name__ == "__main__":
    main(sys.argv)
