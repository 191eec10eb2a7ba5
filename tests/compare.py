"""Run registered queries in Spark and their oracle SQL in DuckDB; compare."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from incidentlab.session import scratch_scope

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if isinstance(v, float):
        return float(repr(v))
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    with scratch_scope(spark):
        s = query(spark, sf_dir).toPandas()
    d = duck(sf_dir).execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: {sorted(s.columns)} vs {sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count {len(s)} vs {len(d)}"
    a, b = frame_rows(s), frame_rows(d)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0]}"
    return True, f"{len(s)} rows equal"


if __name__ == "__main__":
    import __spark_entry__ as E
    from incidentlab.session import get_session
    import json
    conf = {"spark.sql.session.timeZone": os.environ.get("SESSION_TZ", "UTC")}
    conf.update(json.loads(os.environ.get("SPARK_CONF_JSON", "{}")))
    spark = get_session("local[8]", shuffle_partitions=8, conf=conf)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    oracles = E.oracle_sql()
    for n in names:
        if n not in oracles:
            print(f"{n}: no oracle (rows={E.queries()[n](spark, sf).count()})", flush=True)
            continue
        ok, msg = compare(spark, n, sf, E.queries()[n], oracles[n])
        print(f"{n}: {'OK' if ok else 'FAIL'} {msg}", flush=True)
