"""The registered queries, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import CHILD_ADVANCES, CHILD_CREDITS, CHILD_SEQUENCES, COVERAGE, ENTRIES, GAMES, PARKS, PEOPLE, PLAY_TAGS, PLAYS, ROSTERS, TEAMS, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = f"WITH plays AS ({PLAYS}), games AS ({GAMES}), play_tags AS ({PLAY_TAGS}), advances AS ({CHILD_ADVANCES}), sequences AS ({CHILD_SEQUENCES}), credits AS ({CHILD_CREDITS}), entries AS ({ENTRIES}), people AS ({PEOPLE}), rosters AS ({ROSTERS}), teams AS ({TEAMS}), parks AS ({PARKS}), coverage AS ({COVERAGE})"


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def on_table(name: str, table: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda spark, d: query(spark.read.parquet(f"{d}/{table}.parquet")), sql)


def on_view(name: str, source: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda spark, d: query(view(spark, d, source)), f"{WITH} {sql}")


def literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A list of rows as a table, numbered by i."""
    return f"(VALUES {', '.join(f'({i}, {chr(44).join(map(literal, row))})' for i, row in enumerate(rows))}) c(i, {columns})"
