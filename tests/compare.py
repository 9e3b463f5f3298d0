"""Run registered queries beside their SQL in DuckDB and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else v + 0.0
            if isinstance(v, list):
                v = tuple(v)
            vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name, build, sql, sf_dir):
    """Empty string when both agree, else a description of the first difference."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "", len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    for c, t in df.dtypes:
        if t in KINDS and kinds[c] not in (KINDS[t], {"VARCHAR": "STRING", "DOUBLE": "NUMBER", "BIGINT": "NUMBER"}.get(KINDS[t])):
            return f"type of {c}: {t} vs {kinds[c]}", len(got)
    a, b = normal(got, df.columns), normal(want, cols)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(got)
    names = sorted(df.columns)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
        return f"{len(bad)} of {len(a)} rows differ, e.g. {diff} in {dict(zip(names, x))}", len(got)
    return "", len(got)


def main(argv):
    from signalgrid.queries import load_all
    from signalgrid.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = "/root/testdata/sf0.01"
    con = connect(sf_dir)
    failed = []
    for name, q in load_all().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            problem, n = compare(spark, con, name, q.build, q.sql, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        print(f"{'FAIL' if problem else 'ok  ' if q.sql else 'rows'} {name} rows={n} {time.time() - t:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
