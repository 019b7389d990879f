"""Runs a query and its SQL side by side and compares the rows, in any order."""

import os


def duck(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows), sorted(columns)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    mine = canon(df.collect(), df.columns)
    cur = duck(folder).execute(sql)
    names = [x[0] for x in cur.description]
    return mine, canon(cur.fetchall(), names)
