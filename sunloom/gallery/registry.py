"""Registry of runnable queries and the SQL that must give the same rows."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.functions.values import clean_doubles
from sunloom.gallery.fixtures import SQL_TABLES, Tables
from sunloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_tables(sql: str, recursive: bool = False) -> str:
    """Prefix the adapter tables a statement mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_TABLES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    order = [n for n in SQL_TABLES if n in needed]
    head = ", ".join(f"{n} AS ({SQL_TABLES[n]})" for n in order)
    sql = sql.strip()
    kind = "WITH RECURSIVE " if recursive else "WITH "
    if not head:
        return sql if not recursive or sql.upper().startswith("WITH") else kind + sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{kind}{head}, {sql[len(start):]}"
    return f"{kind}{head} {sql}"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places (cut off the .5 ties both engines may see differently), instants zone-free, integers widened: the form both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.floor(c.cast("double") * 1e6 + 0.4637).cast("double") / 1e6
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return clean_doubles(df.select(*out))


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), recursive: bool = False, longs: Sequence[str] = ()):
    """Register `fn(tables) -> DataFrame`; the SQL's `doubles` are rounded and its `longs` widened as `tidy` does here."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            answer = fn(Tables(prepare(spark), sf_dir))
            return answer if sql is None else tidy(answer)  # only answers that are compared are put in the common form

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            body = with_tables(sql, recursive)
            fixed = [f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.4637) / 1e6 AS {c}" for c in doubles]
            fixed += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
            if fixed:
                body = f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({body}) AS answer"
            ORACLES[name] = body
        return fn

    return register
