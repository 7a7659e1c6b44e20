"""Tables in hash buckets, of which an update rewrites only the ones that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.session import cut_lineage

BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def create_buckets(df: DataFrame, root: str, name: str, key: str, buckets: int) -> None:
    """Write a new table, one folder per bucket of ``key``. A null key has a bucket like any other."""
    dealt = df.withColumn(BUCKET, bucket_of(key, buckets))
    dealt.repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(_path(root, name))


def read_buckets(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows; filters on ``bucket`` read the folders they name and no others."""
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(_path(root, name))


def replace_buckets(after: DataFrame, touched: DataFrame, root: str, name: str, key: str, buckets: int) -> None:
    """Put the rows of ``after`` in place of the buckets that ``touched`` (column ``bucket``) names.

    ``after`` has all rows of those buckets, in any order, and may come from the table itself: it is
    materialised before a folder changes. Other folders keep their files. A bucket that has no row
    left loses its folder. A job that dies between two folders leaves each either old or new, and the
    update can be made again.
    """
    spark = after.sparkSession
    dealt = after.drop(BUCKET).withColumn(BUCKET, bucket_of(key, buckets))
    ready = cut_lineage(dealt.join(touched.select(BUCKET).distinct(), BUCKET, "left_semi"))
    ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(_path(root, name))
    # Bucket numbers, at most ``buckets`` of them, as folder names are.
    empty = touched.select(BUCKET).distinct().join(ready.select(BUCKET).distinct(), BUCKET, "left_anti")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in empty.collect():
        folder = jvm.org.apache.hadoop.fs.Path(f"{_path(root, name)}/{BUCKET}={row[BUCKET]}")
        folder.getFileSystem(conf).delete(folder, True)
