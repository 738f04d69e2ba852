"""Registry of named queries and, where SQL can say it, the same query as one SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.numbers import fix_any

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(func: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return register


def present(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Result columns in portable types: times as text, flags as 0/1, doubles rounded."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in cols or df.columns:
        c, t = F.col(f"`{name}`"), types[name]
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.BooleanType):
            c = c.cast("int")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = fix_any(c, digits)
        out.append(c.alias(name))
    return df.select(*out)
