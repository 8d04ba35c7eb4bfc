"""Run registered queries on Spark and their SQL twins on DuckDB, and compare.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


FAMILY = {
    "double": "float", "float": "float", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int",
    "string": "text", "boolean": "bool",
}


def family(t: str) -> str:
    t = t.lower()
    if t in FAMILY:
        return FAMILY[t]
    if t.startswith(("decimal", "numeric")):
        return "decimal"
    if t in ("varchar",):
        return "text"
    if t in ("integer", "hugeint", "uinteger", "ubigint", "utinyint", "usmallint"):
        return "int" if t in ("integer",) else t
    return t


def run_pair(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(x) for x in df.select(*[f"`{c}`" for c in cols]).collect()]
    seconds = time.time() - start
    if sql is None:
        return None, f"{len(rows)} rows", seconds
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    types = dict(zip(names, (str(x[1]) for x in cursor.description)))
    got = cursor.fetchall()
    if sorted(names) != cols:
        return False, f"columns differ: {cols} vs {sorted(names)}", seconds
    order = [names.index(c) for c in cols]
    mine = sorted(tuple(canonical(v) for v in row) for row in rows)
    theirs = sorted(tuple(canonical(row[i]) for i in order) for row in got)
    note = ""
    for c in cols:
        a, b = family(dict(df.dtypes)[c]), family(types[c])
        if a != b and not (a.startswith("array") or a.startswith("struct")):
            note += f" [{c}: {dict(df.dtypes)[c]} vs {types[c]}]"
    if mine == theirs:
        return (not note), f"{len(rows)} rows equal{note}", seconds
    a, b = set(mine), set(theirs)
    only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
    return False, f"{len(mine)} vs {len(theirs)} rows; spark-only {str(only_a)[:700]}; sql-only {str(only_b)[:700]}", seconds


def main() -> int:
    from marklake.plans import registry
    from marklake.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note, seconds = run_pair(spark, con, name, fn, registry.ORACLES.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note, seconds = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += ok is False
        print(f"\n{'rows' if ok is None else 'ok  ' if ok else 'BAD '} {name:<36} {seconds:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
