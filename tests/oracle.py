"""Runs registered queries next to their SQL checks.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

import datetime
import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value) if value != int(value) else int(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows), sorted(names)


def check(spark, folder, name, fn, sql, con):
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    got, cols = normal(df.columns, rows)
    if sql is None:
        return len(got) > 0, f"rows {len(got)} (no SQL check) {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_cols = normal(names, cur.fetchall())
    if cols != want_cols:
        return False, f"columns {cols} vs {want_cols}"
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return False, f"rows {len(got)} vs {len(want)}\n   spark only: {extra}\n   sql only:   {missing}"
    digest = hashlib.md5("\n".join(got).encode()).hexdigest()[:8]
    return len(got) > 0, f"rows {len(got)} {digest} {took:.1f}s"


def main(argv):
    import __spark_entry__ as entry
    from lodegraph.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, note = check(spark, folder, name, fn, entry.oracle_sql().get(name), con)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
