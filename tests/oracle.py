"""Compare a query's rows with those of its SQL on DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, int):
        return f"{x:.6g}" if abs(x) < 1 << 20 else str(x)
    return str(x)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_value(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(_value(r[i]) for i in order) for r in rel.fetchall())


def kinds(df):
    """Coarse types by column, to hold both sides to the same schema."""
    plain = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "timestamp_ntz": "timestamp"}
    return {c: plain.get(t, t.split("(")[0]) for c, t in df.dtypes}


def kinds_of_sql(con, sql):
    rel = con.sql(sql)
    plain = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "hugeint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DECIMAL": "decimal"}
    return {c: plain.get(str(t).split("(")[0], str(t).lower()) for c, t in zip(rel.columns, rel.types)}
