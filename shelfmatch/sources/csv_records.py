"""CSV records with exact record and line numbers, read in parallel splits.

Spark's own multi-line CSV mode reads a file in one task and gives no line numbers. Here lines are
numbered from the splits they came in. A quote opens a cell only at the cell's start, so what a line
does to the quoting depends only on whether it starts inside a cell: each line is one of four maps of
that state, and the maps are composed in bands of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmatch.skew import banded_previous, banded_rank

BAND = 100_000
#: A quoted cell with what may follow its closing quote, or a plain one, where quotes are literal.
QUOTED = r'"(?:[^"]|"")*+"[^,]*+'
CELL = rf'(?:{QUOTED}|(?!")[^,]*+)'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with physical line numbers from 1 in each file."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = raw.groupBy("file", "block").agg(F.min("mid").alias("m0"), F.count(F.lit(1)).alias("n")).select(
        "file", "block", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    line = F.col("mid") - F.col("m0") + F.col("before") + 1
    value = F.when(line == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return raw.join(offsets, ["file", "block"]).select("file", line.alias("line"), value.alias("value"))


def records(lines: DataFrame) -> DataFrame:
    """(file, start_line, line, value, unclosed) of (file, line, value).

    ``line`` is the last physical line of the record. A quote that is never closed leaves the rest of
    its file without records: one row with ``unclosed`` stands for it, with its first line only, so
    that no task gathers a file's rest.
    """
    from_outside = ~F.col("value").rlike(rf"(?s)^{CELL}(?:,{CELL})*$")
    from_inside = ~F.col("value").rlike(rf'(?s)^(?:[^"]|"")*+"[^,]*+(?:,{CELL})*$')
    # A line sets the state whatever it was, keeps it, or turns it.
    fixed = F.when(from_outside == from_inside, from_outside.cast("int"))
    turns = F.when(from_outside & ~from_inside, 1).otherwise(0)
    marked = lines.withColumns({"fixed": fixed, "turns": turns, "band": F.floor(F.col("line") / BAND)})
    bands = marked.groupBy("file", "band").agg(F.sum("turns").alias("n"))
    earlier = Window.partitionBy("file").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bands.select("file", "band", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("file", "band").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("local", F.sum("turns").over(upto)).join(offsets, ["file", "band"]).withColumn(
        "turned", (F.col("local") + F.col("offset")) % 2)
    # The last line that set the state, and which turn it cancelled.
    base = F.when(F.col("fixed").isNotNull(), F.col("line") * 2 + F.col("fixed").bitwiseXOR(F.col("turned").cast("int")))
    keyed = counted.select("file", "line", "value", "turned", base.alias("base"))
    band = F.floor(F.col("line") / BAND)
    state = banded_previous(keyed, ["file"], [F.col("line")], band, running_max={"set": "base"}, previous={}, first={})
    ends = state.select("file", "line", "value", (
        F.coalesce(F.col("set") % 2, F.lit(0)).cast("int").bitwiseXOR(F.col("turned").cast("int")) == 1).alias("inside"))
    # The next line starts a record where this one ends outside: numbers of such lines rise with the lines.
    ended = ends.withColumn("next", F.when(~F.col("inside"), F.col("line") + 1))
    tracked = banded_previous(ended, ["file"], [F.col("line")], band, running_max={"after": "next"}, previous={}, first={})
    starts = tracked.withColumn("start_line", F.when(
        F.col("after") == F.col("line") + 1, F.lit(None)).otherwise(F.coalesce("after", F.lit(1))))
    # A line that ends outside belongs to the record that the last ending before it began.
    before = banded_previous(
        starts, ["file"], [F.col("line")], band, running_max={}, previous={"start_before": "after"}, first={})
    placed = before.withColumn("start_line", F.coalesce("start_line", "start_before", F.lit(1)))
    closed = placed.groupBy("file").agg(F.max("after").alias("open_from"), F.max("line").alias("last"))
    told = placed.join(closed, "file").withColumn("unclosed", F.coalesce(F.col("open_from"), F.lit(1)) <= F.col("line"))
    kept = told.where(~F.col("unclosed") | (F.col("line") == F.col("start_line")))
    # One record's lines; records are as long as their cells.
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))
    return kept.groupBy("file", "start_line").agg(
        F.max("line").alias("line"), parts.alias("p"), F.bool_or("unclosed").alias("unclosed")
    ).select("file", "start_line", "line", F.array_join(F.transform("p", lambda e: e["value"]), "\n").alias("value"), "unclosed")


def cells(value: Column) -> Column:
    """All cells of a record, unquoted; what follows a closing quote is literal."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(rf'(?s),({CELL}|".*)'), F.lit(1))
    opened = r'(?s)^"((?:[^"]|"")*+)"?(.*)$'

    def plain(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, opened, 1), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"'), F.concat(inner, F.regexp_extract(c, opened, 2))).otherwise(c)

    return F.transform(raw, plain)


def header_and_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header cells, and the other records as (file, start_line, line, value, unclosed, cells)."""
    table = records(numbered_lines(spark, path))
    first = table.where("start_line = 1").select(cells(F.col("value")).alias("c")).first()
    if first is None:
        raise ValueError(f"CSV has no header: {path}")
    rows = table.where("start_line > 1").select("file", "start_line", "line", "value", "unclosed", cells(F.col("value")).alias("cells"))
    return first["c"], rows


def numbered_records(rows: DataFrame) -> DataFrame:
    """Adds ``record``: 1 for the first non-empty record of a file."""
    return banded_rank(
        rows.where("value <> ''"), ["file"], [F.col("start_line")], F.floor(F.col("start_line") / BAND), "record"
    )
