"""Compare registered queries with their DuckDB counterparts: python tests/oracle_check.py SF_DIR [name ...]"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from pisoval.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None else (repr(float(v)) if type(v).__name__ == "Decimal" else str(v))


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != columns:
        return f"COLUMNS differ: {columns} / {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    types = {c[0]: str(c[1]) for c in cur.description}
    if got == want:
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        odd = [f"{c}:{kinds[c]}/{types[c]}" for c in columns
               if {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kinds[c]) != types[c]]
        return f"ok {len(got)} rows {took:.1f}s" + (f" types {odd}" if odd else "")
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return (f"MISMATCH rows {len(got)}/{len(want)} differing {len(only_got)}/{len(only_want)}\n   {columns}\n"
            + "\n".join(f"   got  {str(a)[:600]}\n   want {str(b)[:600]}" for a, b in list(zip(only_got, only_want))[:2]))


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, con = local_session(), duckdb.connect()
    spark.sparkContext.setLogLevel("ERROR")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in names:
        try:
            print(name, compare(spark, con, name, sf_dir), flush=True)
        except Exception as e:  # report and go on
            print(name, "FAILED", type(e).__name__, str(e)[:500].replace("\n", " "), flush=True)


if __name__ == "__main__":
    main()
