"""Run registered queries beside their SQL and compare schema, row count and values."""

from __future__ import annotations

import math
import os
import signal
import sys
import time

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


_KINDS = {"tinyint": "int", "integer": "int", "bigint": "bigint", "double": "double", "varchar": "string"}


def _norm(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(spark_df, relation) -> str | None:
    """None when both hold the same bag of rows under the same names and types."""
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} != {sorted(relation.columns)}"
    kinds = {n: str(t).lower() for n, t in zip(relation.columns, relation.types)}
    for field in spark_df.schema.fields:
        expected = _KINDS.get(kinds[field.name], kinds[field.name])
        if field.dataType.simpleString() != expected:
            return f"type of {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}"
    left = sorted((tuple(_norm(v) for v in r) for r in spark_df.select(*names).collect()), key=_order)
    quoted = ", ".join(f'"{n}"' for n in names)
    right = sorted((tuple(_norm(v) for v in r) for r in relation.project(quoted).fetchall()), key=_order)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference: {a} != {b}"
    return None


def main():
    from tests.session import local_session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    limit = int(os.environ.get("QUERY_LIMIT", "300"))

    def stop(*_):
        raise TimeoutError(f"no result after {limit} s")

    signal.signal(signal.SIGALRM, stop)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        signal.alarm(limit)
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                result = difference(df, con.sql(oracles[name])) or "same"
            else:
                rows = df.collect()
                result = f"rows only: {len(rows)} {rows[:8]}"
        except Exception as error:
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        signal.alarm(0)
        print(f"{name:32s} {time.time() - started:6.1f}s  {result[:1200]}", flush=True)


if __name__ == "__main__":
    main()
