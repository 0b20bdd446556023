"""Runs a query beside its SQL and compares rows and column names."""

import datetime
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def compare(df, sql, folder):
    """None if alike, else what differs."""
    cur = duck(folder).execute(sql)
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    if want == got:
        return None
    all_got, all_want = set(got), set(want)
    extra, missing = [x for x in got if x not in all_want][:2], [x for x in want if x not in all_got][:2]
    return f"{len(got)} rows against {len(want)}; only here {str(extra)[:400]}; only in SQL {str(missing)[:400]}"
