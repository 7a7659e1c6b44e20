"""Registered queries and the tables they read.

The driver's tables stand in for catalog, references, votes and recognised text. Every view is a
deterministic projection or grouping of whole tables; ``VIEWS`` states the same view in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Names(dict):
    """A registry; a name can be given once."""

    def __setitem__(self, name: str, value) -> None:
        if name in self:
            raise ValueError(f"{name} is registered already")
        super().__setitem__(name, value)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = Names()
ORACLE: dict[str, str] = Names()

CARD_URL = "https://catalog.example.org/items"


class Tables:
    """Lazily read driver tables and derived views."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            df = DERIVED[name](self)
        else:
            df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            df = _with_utc(df, "ts") if name == "events" else df
        self.__dict__[name] = df  # one plan per view and query
        return df


def _with_utc(df: DataFrame, column: str) -> DataFrame:
    """Zone-free times as UTC instants, whatever the session's zone."""
    if df.schema[column].dataType != T.TimestampNTZType():
        return df
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return df.withColumn(column, F.timestamp_micros(micros))


DERIVED: dict[str, Callable[[Tables], DataFrame]] = Names()
VIEWS: dict[str, str] = Names()


def view(sql: str):
    """Register a derived view and its SQL text."""
    def add(function: Callable[[Tables], DataFrame]):
        DERIVED[function.__name__] = function
        VIEWS[function.__name__] = sql
        return function

    return add


def _plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL side has them."""
    wide = {T.IntegerType(): "bigint", T.ShortType(): "bigint", T.FloatType(): "double"}
    return df.select(*[
        F.col(f.name).cast(wide[f.dataType]).alias(f.name) if f.dataType in wide else F.col(f.name) for f in df.schema
    ])


def query(sql: str | None = None, using: list[str] = [], big: list[str] = []):
    """Register a query; ``using`` names the views its SQL reads, ``big`` the columns to widen."""
    def add(function: Callable[[Tables], DataFrame]):
        name = function.__name__.strip("_")
        QUERIES[name] = lambda spark, root: _plain_types(function(Tables(spark, root)))
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in using)
            widened = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in big)
            body = f"SELECT * REPLACE ({widened}) FROM ({sql.strip()})" if big else sql.strip()
            ORACLE[name] = (f"WITH {ctes} " if ctes else "") + body
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions rounded, so that summation order does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])
