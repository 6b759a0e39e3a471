"""The catalogue of queries: each has a function (spark, sf_dir) -> DataFrame and, if SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.lake import SQL_TABLES, Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Lake], DataFrame]], Callable[[Lake], DataFrame]]:
    """Registers a function of the lake; lake tables named in ``sql`` become common table expressions."""

    def register(f: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Lake(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return f

    return register


def with_tables(sql: str) -> str:
    """The SQL behind the lake tables that it names, each before those that use it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_TABLES.items():
            if f"lake_{name}" in text and name not in needed:
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    tables = ", ".join(f"lake_{n} AS ({SQL_TABLES[n]})" for n in needed)
    sql = sql.strip()
    return f"WITH RECURSIVE {tables}, {sql[len('WITH RECURSIVE ') :]}" if sql.startswith("WITH RECURSIVE ") else f"WITH RECURSIVE {tables} {sql}"
