"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.session import checkpoint_dir

#: Characters that separate words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder once and read it from there in every later branch."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that nested lambdas do not evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def parts_for(df: DataFrame, text: str, chars_per_part: int) -> int:
    """Number of equal parts so that each has about ``chars_per_part`` characters."""
    total = df.select(F.sum(F.length(text))).first()[0] or 0
    return 1 + total // chars_per_part
