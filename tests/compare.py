"""Run registered queries beside their SQL in DuckDB: python -m tests.compare <sf> [names]."""

from __future__ import annotations

import sys
import time

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        out = []
        for v in row:
            if hasattr(v, "tolist"):
                v = v.tolist()
            if v is None or v is pd.NA or v is pd.NaT or v != v:
                out.append("NULL")
            elif isinstance(v, float):
                # A column of whole numbers with NULLs arrives as float.
                out.append(str(int(v)) if v == int(v) else repr(round(v, 9)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def without_sql() -> set[str]:
    """Queries that SQL cannot state; other tests hold them against brute force."""
    try:
        from tests.llm.listed import WITHOUT_SQL
    except ModuleNotFoundError:
        return set()
    return WITHOUT_SQL


def compare(spark, con, name, queries, oracle, root):
    started = time.time()
    df = queries[name](spark, root)
    got = df.toPandas()
    seconds = time.time() - started
    if name not in oracle:
        return name in without_sql(), f"{name}: no SQL, {len(got)} rows, {seconds:.1f}s"
    started = time.time()
    rel = con.sql(oracle[name])
    want = rel.df()
    sql_seconds = time.time() - started
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} <> {sorted(want.columns)}"
    families = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (t, duck_types[c]) for c, t in df.dtypes if t in families and families[t] != duck_types[c]}
    a, b = canonical(got), canonical(want)
    if a != b:
        differ = [x for x in zip(a, b) if x[0] != x[1]][:2]
        only_a, only_b = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
        return False, f"{name}: rows {len(a)} / {len(b)}\n   spark only {only_a}\n   sql only {only_b}\n"
    return True, f"{name}: ok {len(a)} rows, {seconds:.1f}s, sql {sql_seconds:.1f}s" + (f" types {odd}" if odd else "")


def main() -> int:
    import __spark_entry__ as entry
    from shelfmatch.session import build_session

    root = f"/root/testdata/{sys.argv[1]}"
    spark, con = build_session(cpus=8), duck(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        try:
            ok, message = compare(spark, con, name, queries, oracle, root)
        except Exception as error:
            lines = str(error).splitlines()
            cause = [x for x in lines if "Caused by" in x or "Error:" in x or "[" in x[:2]][:4]
            ok, message = False, f"{name}: {type(error).__name__} {' / '.join(cause or lines[:3])[:900]}"
        bad += not ok
        print("   " if ok else "BAD", message, flush=True)
    print(f"{len(names)} queries, {sum(n in oracle for n in names)} with SQL, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
