"""Run registered queries on Spark and their SQL oracle on DuckDB, and compare
row count, column names and an order-insensitive digest of the values."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if isinstance(v, dict):
        return repr({k: _norm(x) for k, x in sorted(v.items())})
    if isinstance(v, bool):
        return repr(int(v))
    if isinstance(v, int):
        return repr(v)
    return repr(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple("" if x is None else x for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> dict:
    res = {"rows_spark": len(spark_pdf), "rows_duck": len(duck_pdf),
           "cols_ok": sorted(spark_pdf.columns) == sorted(duck_pdf.columns)}
    if not res["cols_ok"]:
        res["cols_spark_only"] = sorted(set(spark_pdf.columns) - set(duck_pdf.columns))
        res["cols_duck_only"] = sorted(set(duck_pdf.columns) - set(spark_pdf.columns))
        res["match"] = False
        return res
    for c in duck_pdf.columns:  # a whole-number column with nulls: floats in one frame, nullable integers in the other
        if str(duck_pdf[c].dtype) == "Int64" and spark_pdf[c].dtype.kind == "f":
            spark_pdf = spark_pdf.astype({c: "Int64"})
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    ha = hashlib.sha256(repr(a).encode()).hexdigest()
    hb = hashlib.sha256(repr(b).encode()).hexdigest()
    res["match"] = (ha == hb) and len(a) == len(b)
    if not res["match"] and len(a) == len(b):
        cols = sorted(spark_pdf.columns)
        bad = set()
        for ra, rb in zip(a, b):
            for i, (x, y) in enumerate(zip(ra, rb)):
                if x != y:
                    bad.add(cols[i])
        res["bad_cols"] = sorted(bad)[:10]
        for ra, rb in zip(a, b):
            if ra != rb:
                res["first_diff"] = [(cols[i], x, y) for i, (x, y) in enumerate(zip(ra, rb)) if x != y][:4]
                break
    return res


def run(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from vigil.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or sorted(qs)):
        t = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = {"error": f"spark: {type(e).__name__}: {str(e)[:400]}"}
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t
        if name not in orc:
            results[name] = {"rows_spark": len(sp), "oracle": None, "sec": round(ts, 2)}
            print(name, results[name], flush=True)
            continue
        try:
            dk = con.sql(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = {"error": f"duck: {type(e).__name__}: {str(e)[:400]}"}
            print(name, results[name], flush=True)
            continue
        r = compare(sp, dk)
        r["sec"] = round(ts, 2)
        results[name] = r
        print(name, r, flush=True)
    return results


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    res = run(args or None, sf)
    ok = sum(1 for r in res.values() if r.get("match"))
    print(f"MATCH {ok}/{sum(1 for r in res.values() if r.get('oracle', 1) is not None)}  total {len(res)}")
