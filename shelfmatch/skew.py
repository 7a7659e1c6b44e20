"""Per-key ranking and first-row selection that hold when one key owns much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the row with the smallest ``order`` per key.

    An aggregate, not a window: partial minima are formed before the shuffle, so a hot key
    sends one row per task. ``order`` must end in a unique column.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The ``n`` first rows per key. Spark limits each task's group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    limited = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return limited.withColumn(rank, F.col(rank).cast("long"))


def rank_bounded(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Row number for groups whose size an earlier top-k already bounds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def banded_rank(
    df: DataFrame, keys: list[str], order: list[Column], band: Column, rank: str = "rank"
) -> DataFrame:
    """Exact row number inside groups of any size.

    ``band`` is a non-null coarse value that never falls as ``order`` rises. Rows are numbered
    inside (keys, band), and the number of rows in earlier bands of the same key is added. No
    task sees more than one band of a group; the band counts are pre-aggregated and small.
    """
    banded = df.withColumn("__band", band)
    group = [*keys, "__band"]
    offsets = (
        banded.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in group],
            F.coalesce(F.sum("__n").over(
                Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0)).alias("__offset"),
        )
    )
    local = banded.withColumn("__local", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in group])
    return (
        local.join(offsets, match, "left")
        .withColumn(rank, (F.col("__local") + F.col("__offset")).cast("long"))
        .select(*df.columns, rank)
    )


def range_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Exact row number over the whole of ``df``, whose ``order`` must end in a unique column.

    Rows are dealt into ranges of the whole order by sampled bounds, so no value, however common, puts
    more than its share into one range. The dealing is written once, then ranges are numbered apart
    and the counts of earlier ranges added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    # One row per range: a bounded number.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(offsets, "__part").withColumn(rank, (F.col("__local") + F.col("__offset")).cast("long")).select(*df.columns, rank)


def quantile_band(df: DataFrame, value: Column, bands: int = 64) -> Column:
    """Number of the band of ``value`` by quantiles of ``df``: bands of like size that rise with the value."""
    cuts = df.agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 10_000).alias("c")).first()["c"]
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < value))


def banded_previous(
    df: DataFrame, keys: list[str], order: list[Column], band: Column,
    running_max: dict[str, str], previous: dict[str, str], first: dict[str, str],
) -> DataFrame:
    """Running maximum, previous value and first value inside groups of any size.

    Each mapping is output name -> input column; ``previous`` and ``first`` inputs must rise with
    ``order``, as timestamps do. One band of a group is one window; band summaries are carried
    across.
    """
    banded = df.withColumn("__band", band)
    group = [*keys, "__band"]
    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("__band")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = banded.groupBy(*group).agg(
        *[F.max(c).alias(f"__m_{o}") for o, c in running_max.items()],
        *[F.max(c).alias(f"__p_{o}") for o, c in previous.items()],
        *[F.min(c).alias(f"__f_{o}") for o, c in first.items()],
    )
    carried = summary.select(
        *[F.col(k).alias(f"__k_{k}") for k in group],
        *[F.max(f"__m_{o}").over(earlier).alias(f"__c_{o}") for o in running_max],
        *[F.max(f"__p_{o}").over(earlier).alias(f"__c_{o}") for o in previous],
        *[F.min(f"__f_{o}").over(whole).alias(f"__c_{o}") for o in first],
    )
    local = banded.select(
        "*",
        *[F.max(c).over(upto).alias(f"__l_{o}") for o, c in running_max.items()],
        *[F.lag(c).over(inside).alias(f"__l_{o}") for o, c in previous.items()],
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in group])
    joined = local.join(carried, match, "left")
    return joined.select(
        *df.columns,
        *[F.greatest(f"__l_{o}", f"__c_{o}").alias(o) for o in running_max],
        *[F.coalesce(f"__l_{o}", f"__c_{o}").alias(o) for o in previous],
        *[F.col(f"__c_{o}").alias(o) for o in first],
    )
