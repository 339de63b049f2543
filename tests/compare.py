"""Run queries and their SQL side by side: ``python -m tests.compare [sf_dir] [name ...]``."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, run, sql, sf_dir):
    """Empty text if both sides agree, otherwise what differs."""
    df = run(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if got else "no rows"
    res = con.execute(sql)
    names, want = [d[0] for d in res.description], res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}; {left[:2]} {right[:2]}"
    off = [(a, b) for a, b in zip(left, right) if a != b]
    if off:
        return f"{len(off)} of {len(left)} rows differ: {off[:2]}"
    kinds = {n: t for n, t in df.dtypes}
    odd = [f"{d[0]} {kinds[d[0]]}/{d[1]}" for d in res.description if not same_kind(kinds[d[0]], str(d[1]))]
    return f"types {odd}" if odd else ""


def same_kind(spark_type, duck_type):
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return pairs.get(spark_type, spark_type.upper()) == duck_type


def main(argv):
    import __spark_entry__ as entry
    from talkmill.session import get_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_spark("compare", cpus=8)
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        begin = time.time()
        try:
            off = differences(spark, con, run, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            off = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(off)
        print(f"{'BAD ' if off else 'ok  '}{name:28s}{time.time() - begin:7.1f}s {'' if name in sqls else '(no SQL) '}{off}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
