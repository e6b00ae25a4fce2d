"""Run registered queries and their SQL side by side on the tables of one folder."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _rows(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


# Type names that mean the same column type in both engines.
_SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def differences(spark: SparkSession, connection: duckdb.DuckDBPyConnection, name: str, folder: str) -> str | None:
    """None when rows, column names and types agree, else what does not."""
    result = queries()[name](spark, folder)
    ours = _rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = connection.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} != {sorted(names)}"
    types = {n: str(d[1]) for n, d in zip(names, cursor.description)}
    for column, kind in result.dtypes:
        if _SAME_TYPE.get(kind, kind) != types[column]:
            return f"type of {column}: {kind} != {types[column]}"
    if ours != theirs:
        ours_only, theirs_only = set(ours) - set(theirs), set(theirs) - set(ours)
        return (
            f"{len(ours)} rows against {len(theirs)}; only ours {len(ours_only)}: {sorted(ours_only)[:2]}; "
            f"only SQL {len(theirs_only)}: {sorted(theirs_only)[:2]}"
        )
    if not ours:
        return "no rows"
    return None


def main() -> None:
    from stockline.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql = oracle_sql()
    bad = 0
    for name in wanted:
        begin = time.time()
        try:
            if name in sql:
                problem = differences(spark, connection, name, folder)
            else:
                problem = f"no SQL; {queries()[name](spark, folder).count()} rows"
        except Exception as error:  # report every query, not only the first that fails
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
