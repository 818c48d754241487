"""Local stand-in for the driver's correctness gate: run each registered query in Spark
and its oracle SQL in DuckDB on the same parquet tables and compare row count, column
names and order-insensitive values.  Usage: python tests/oracle_check.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if STRICT:  # exact binary value and sign
            return repr(v)
        return round(v, 9) + 0.0
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows), "spark_sec": round(t1 - t0, 2)}
    res["cols_ok"] = sorted(scols) == sorted(dcols)
    spark_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {c: str(t) for c, t in zip(dcols, rel.types)}
    bad_types = {c: (spark_types[c], duck_types.get(c)) for c in spark_types if duck_types.get(c) != spark_types[c]}
    res["types_ok"] = not bad_types
    if bad_types:
        res["types"] = bad_types
    if not res["cols_ok"]:
        res["cols"] = (sorted(set(scols) - set(dcols)), sorted(set(dcols) - set(scols)))
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    res["values_ok"] = a == b
    if not res["values_ok"]:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diffs
    return res


def main():
    from ricefield.session import local_session
    import __spark_entry__ as E

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            print(f"{name}: no oracle")
            continue
        try:
            r = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": repr(e)[:800]}
        ok = r.get("values_ok") and r.get("types_ok") and r.get("spark_rows") == r.get("duck_rows")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
