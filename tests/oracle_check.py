"""Run every registered query on Spark and its SQL on DuckDB and compare the rows.

    python tests/oracle_check.py /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    a = sorted((repr([norm(r[c]) for c in order]) for r in spark_rows))
    at = [duck_cols.index(c) for c in order]
    b = sorted((repr([norm(r[i]) for i in at]) for r in duck_rows))
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pollmirror.session import local_session

    sf_dir, names = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or list(queries):
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = df.collect()
            t1 = time.time()
            if name in oracle:
                res = con.execute(oracle[name])
                cols = [d[0] for d in res.description]
                problem = compare(rows, df.columns, res.fetchall(), cols)
                kinds = {d[0]: str(d[1]) for d in res.description}
                for f in df.schema.fields:
                    k, st = kinds.get(f.name, ""), f.dataType.simpleString()
                    ok = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(st)
                    if ok and k and k not in (ok, "STRING", "NUMBER", "bool") and k.upper() != ok:
                        problem = problem or f"type {f.name}: {st} vs {k}"
            else:
                problem = ""
            t2 = time.time()
            print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={len(rows):7d} spark={t1 - t0:6.2f}s sql={t2 - t1:6.2f}s {'' if name in oracle else '(rows only) '}{problem[:600]}", flush=True)
            if problem:
                failed.append(name)
        except Exception as exc:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name:28s} {type(exc).__name__}: {str(exc)[:900]}", flush=True)
    print(f"{len(names or queries) - len(failed)} ok, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
