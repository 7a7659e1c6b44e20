"""Mixing sources to target weights by Pfair scheduling of source blocks (operator 2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmatch.llm.common import let, table
from shelfmatch.skew import banded_rank


def shares(df: DataFrame, source_col: str, weights: dict[str | None, float] | None, exponent: float, resolution: int) -> DataFrame:
    """``__source, __share, __rows``: whole slots of each source in one period.

    Weights are given, or are the row counts to the power ``exponent``. A source gets its part of
    ``resolution`` slots, rounded, and one at least; the period is the sum of the shares. A source with
    weight 0, or without one where weights are given, has no share; if none has a weight, all are equal.
    """
    if any(not 0 <= float(v) < math.inf for v in (weights or {}).values()):
        raise ValueError("weights must be finite and not negative")
    counts = df.groupBy(F.col(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    weight = F.pow("__rows", F.lit(exponent))
    if weights is not None:
        given = [F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*given, F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct("__source", weight.alias("__weight"), "__rows")))
    every = counts.agg(listed.alias("__all"))
    total = F.aggregate("__all", F.lit(0.0), lambda a, x: a + x["__weight"])
    part = F.round(F.lit(resolution) * F.try_divide(F.col("__weight"), F.col("__total")))
    return every.select(total.alias("__total"), F.explode("__all").alias("__one")).select("__total", "__one.*").select(
        "__source", F.when((F.col("__weight") == 0) & (F.col("__total") > 0), 0).otherwise(
            F.greatest(F.lit(1), F.coalesce(part, F.lit(1.0)).cast("int"))).alias("__share"), "__rows",
    )


def _slot(block: Column) -> Column:
    """Slot of a block of a source with a share."""
    share = F.col("__share")
    return F.floor(block / share) * F.col("__period") + F.element_at("__slots", (block % share + 1).cast("int"))


def timetable(parts: DataFrame, block_rows: int) -> DataFrame:
    """The schedule with ``__after``: the first slot of a source without a share, null for the others.

    Such sources follow when the last block of every other has had its slot, one after another in the
    order of their names. One row per source.
    """
    plan = schedule(parts.where("__share > 0")).select(F.col("__source").alias("__planned"), "__period", "__slots")
    blocks = F.ceil(F.col("__rows") / block_rows).cast("long")
    sized = parts.join(plan, F.col("__source").eqNullSafe(F.col("__planned")) & (F.col("__share") > 0), "left").drop("__planned")
    sized = sized.withColumns({"__idle": F.when(F.col("__share") == 0, blocks), "__last": F.when(F.col("__share") > 0, _slot(blocks - 1))})
    before = Window.orderBy(F.col("__source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.max("__last").over(Window.partitionBy()) + 1 + F.coalesce(F.sum("__idle").over(before), F.lit(0))
    return sized.select("__source", "__share", "__period", "__slots", F.when(F.col("__share") == 0, after).cast("long").alias("__after"))


def schedule(parts: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: ``__source, __share, __period, __slots``.

    Block i (from 0) of a source with weight w = share / period is released at floor(i / w) and due
    at ceil((i + 1) / w). Each slot goes to the released block with the earliest deadline, ties to
    the first source. All windows are met, so after any number of slots every source is less than
    one block from its weight; after a whole period all are exact, so the period repeats.
    """
    every = parts.agg(F.array_sort(F.collect_list(F.struct("__source", "__share"))).alias("__all")).select(
        "__all", F.aggregate("__all", F.lit(0).cast("long"), lambda a, x: a + x["__share"]).alias("__period")
    )
    period, sources = F.col("__period"), F.col("__all")

    def due(share: Column, done: Column) -> Column:
        return F.ceil((done + 1) * period / share).cast("long")

    def released(share: Column, done: Column) -> Column:
        return F.floor(done * period / share).cast("long")

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(F.arrays_zip(sources, state["done"]), lambda x, i: F.when(
            released(x["__all"]["__share"], x["done"]) <= slot,
            F.struct(due(x["__all"]["__share"], x["done"]).alias("due"), i.alias("at")),
        ))
        return let(F.array_min(ready)["at"], lambda pick: F.struct(
            F.transform(state["done"], lambda k, i: k + F.when(i == pick, 1).otherwise(0).cast("long")).alias("done"),
            F.concat(state["order"], F.array(pick)).alias("order"),
        ))

    start = F.struct(
        F.transform(sources, lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order")
    )
    run = every.where(period > 0).select(
        "*", F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step)["order"].alias("__order")
    )
    own = F.filter(F.sequence(F.lit(0).cast("long"), period - 1), lambda t: F.col("__order")[t.cast("int")] == F.col("__at"))
    return run.select("__period", "__order", F.posexplode("__all").alias("__at", "__one")).select(
        F.col("__one.__source").alias("__source"), F.col("__one.__share").alias("__share"), "__period", own.alias("__slots")
    )


def mixed(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None,
    exponent: float = 0.5, resolution: int = 1000, block_rows: int = 32, rows_per_band: int = 20_000,
) -> DataFrame:
    """Give every row its place in one stream that holds the target weights at every point.

    Rows of a source are put in the order of the digest of their identifier and cut into blocks of
    ``block_rows``. ``schedule`` deals slots to blocks. A source that has run out leaves its later
    slots empty, so no row is dropped or repeated, and the others keep their places; less-than-one-
    block deviation holds as long as all sources last.

    Sources of weight 0 come after the end of all others, their blocks in a row.

    Adds ``mix_block`` (number inside the source), ``mix_release``, ``mix_deadline``, ``mix_slot`` and
    ``mix_position`` (row place, unique, with gaps) to all columns. A null source is a source of its
    own; null identifiers follow from the digest of nothing; repeated rows get places of their own.
    Columns of these five names are replaced; every other name may occur.

    Rows are numbered in bands of a source's digests, about ``rows_per_band`` each, so that a source
    with a third of all rows is many small windows. The period is at most resolution + sources long.
    """
    rows, own = _mixed(df, id_col, source_col, weights, exponent, resolution, block_rows, rows_per_band)
    return rows.select(*[v for c, v in own if c not in ADDED], *ADDED)


ADDED = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]


def _mixed(
    df: DataFrame, id_col: str, source_col: str, weights: dict[str | None, float] | None, exponent: float, resolution: int,
    block_rows: int, rows_per_band: int,
) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Places beside columns renamed by position, and each given name with its renamed column."""
    names = [f"own{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names))
    rows = df.toDF(*names)
    id_col, source_col = at[id_col], at[source_col]
    plan = timetable(shares(rows, source_col, weights, exponent, resolution), block_rows)
    digits = max(1, math.ceil(math.log(max(2, df.count() / rows_per_band), 16)))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = rows.withColumns({
        "__source": F.col(source_col), "__order": digest,
        "__rest": F.xxhash64(*[c for c in names if rows.schema[c].dataType.typeName() != "map"]),
    })
    order = [F.col("__order"), F.col(id_col).asc_nulls_last(), F.col("__rest")]
    ranked = banded_rank(keyed, ["__source"], order, F.substring("__order", 1, digits), "__rank")
    block, share, period, after = (F.col(c) for c in ("mix_block", "__share", "__period", "__after"))
    slot = F.coalesce(after + block, _slot(block))
    placed = (
        ranked.join(plan.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
        .withColumn("mix_block", F.floor((F.col("__rank") - 1) / block_rows).cast("long"))
        .withColumn("mix_slot", slot.cast("long"))
        .withColumns({
            "mix_release": F.when(after.isNull(), F.floor(block * period / share)).otherwise(F.col("mix_slot")).cast("long"),
            "mix_deadline": F.when(after.isNull(), F.ceil((block + 1) * period / share)).otherwise(F.col("mix_slot") + 1).cast("long"),
            "mix_position": F.col("mix_slot") * block_rows + (F.col("__rank") - 1) % block_rows,
        })
    )
    return placed, [(c, F.col(n).alias(c)) for c, n in at.items()]


def in_order(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None,
    exponent: float = 0.5, resolution: int = 1000, block_rows: int = 32, rows_per_band: int = 20_000,
) -> DataFrame:
    """The rows of ``df`` with their columns, whatever their names, laid out in the order of the mix."""
    rows, own = _mixed(df, id_col, source_col, weights, exponent, resolution, block_rows, rows_per_band)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[v for _, v in own])


def places(laid: DataFrame) -> DataFrame:
    """All columns and ``mix_place``: the number (from 0) of a row of ``in_order`` read back from Parquet.

    A reader may deal files to tasks in any order; the number of the part and the row's place in its
    file say where it was written. Only row counts of files are added up. A column of that name is
    replaced; every other name may occur.
    """
    own = laid.columns
    names = [f"own{i}" for i in range(len(own))]
    file = F.col("__file")
    read = laid.select("*", F.col("_metadata.file_name"), F.col("_metadata.row_index")).toDF(*names, "__file", "__index")
    sizes = read.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    part = F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(part, file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One small row per file; the planner sends it along or shuffles it, by its size.
    return read.join(starts, "__file").select(
        *[F.col(n).alias(c) for c, n in zip(own, names) if c != "mix_place"], (F.col("__before") + F.col("__index")).alias("mix_place")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS k FROM documents GROUP BY source),
w AS (
  SELECT source, greatest(1, CAST(round(1000 * sqrt(k) / (SELECT sum(sqrt(k)) FROM n)) AS BIGINT)) AS share,
    row_number() OVER (ORDER BY source NULLS FIRST) AS place
  FROM n
),
p AS (SELECT list(share ORDER BY place) AS shares, CAST(sum(share) AS BIGINT) AS period FROM w),
run(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(shares, lambda s: 0::BIGINT), 0::BIGINT FROM p
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, i: CASE WHEN i = now THEN k + 1 ELSE k END), now
  FROM (
    SELECT run.t, run.done, list_min(list_filter(list_transform(shares, lambda s, i:
      CASE WHEN (done[i] * period) // s <= t + 1 THEN ((done[i] + 1) * period + s - 1) // s * 1000000 + i END),
      lambda x: x IS NOT NULL)) % 1000000 AS now
    FROM run, p WHERE t + 1 < period
  )
),
slots AS (
  SELECT pick AS place, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM run WHERE t >= 0
),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents
)
SELECT d.doc_id, d.source, r // 32 AS mix_block, (r // 32 * period) // share AS mix_release,
  ((r // 32 + 1) * period + share - 1) // share AS mix_deadline,
  (r // 32) // share * period + slot AS mix_slot,
  ((r // 32) // share * period + slot) * 32 + r % 32 AS mix_position
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN slots ON slots.place = w.place AND nth = (r // 32) % share, p
"""
