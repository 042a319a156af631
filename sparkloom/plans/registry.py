"""Queries by id, with the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
