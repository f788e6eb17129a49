"""Run a registered query in Spark and its oracle SQL in DuckDB, and compare them the way
the driver does: row count, column names, and an order-insensitive hash of the values
with columns sorted by name (floats rounded to 6 places)."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> bool:
    import __spark_entry__ as E

    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t = time.time()
    sp = q(spark, sf_dir).toPandas()
    ts = time.time() - t
    sd = digest(sp)
    if sql is None:
        if verbose:
            print(f"{name}: spark rows={sd[0]} ({ts:.1f}s), no oracle")
        return True
    con = con or duck(sf_dir)
    t = time.time()
    dk = con.execute(sql).df()
    td = time.time() - t
    dd = digest(dk)
    ok = sd == dd
    if verbose:
        print(f"{name}: {'OK' if ok else 'MISMATCH'} spark rows={sd[0]} ({ts:.1f}s) duck rows={dd[0]} ({td:.1f}s)"
              + ("" if sd[1] == dd[1] else f" cols {sd[1]} vs {dd[1]}"))
    return ok


if __name__ == "__main__":
    from vardens.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    import __spark_entry__ as E

    names = sys.argv[1:] or list(E.queries())
    con = duck(sf_dir)
    bad = [n for n in names if not compare(spark, n, sf_dir, con)]
    print("mismatches:", bad)
