"""Versioned Parquet tables and manifests of stored data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.functions import text as X
from shelfmatch.sources.files import with_digests


def _log(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}/_log"


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """Newest complete version of a table; 0 when it was never written."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("version long").parquet(_log(root, name)).agg(F.max("version")).first()
    except AnalysisException:
        return 0
    return row[0] or 0


def _claimed(spark: SparkSession, root: str, name: str, version: int) -> bool:
    """Create the version's claim file; false if another writer has it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/_claims/{version}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(path)


def write_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None, base: int | None = None) -> int:
    """Write the next version and then publish it.

    Readers see the old version until the new one is whole, so a job may read the table it
    replaces, and a job that dies half way leaves the old version in place. Every writer claims a number
    of its own first, so two of them never write into one version; the highest published version is read.

    ``base`` is the version that ``df`` was made from (by default the newest when writing begins). If another
    version has been published since, nothing is published and RuntimeError is raised: read and apply the
    change again. The check comes right before publishing; writers that publish at the very same moment
    are not told apart, so jobs that share a table should not run side by side.
    """
    spark = df.sparkSession
    newest = current_version(spark, root, name)
    base = newest if base is None else base
    version = newest + 1
    while not _claimed(spark, root, name, version):
        version += 1
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root.rstrip('/')}/{name}/version={version}")
    if current_version(spark, root, name) != base:
        raise RuntimeError(f"table {name} has moved on from version {base}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(_log(root, name))
    return version


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root, name)
    if version == 0:
        raise FileNotFoundError(f"table {name} has no version below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/version={version}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an existing database; pass partitioning options for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_manifest_csv(manifest: DataFrame, candidates: DataFrame, path: str) -> None:
    """Photo manifest as CSV, with the candidates of ambiguous names beside it.

    A key shared by very many files has one candidate row per file, never one cell that holds all.
    """
    manifest.write.mode("errorifexists").option("header", "true").csv(path)
    candidates.write.mode("errorifexists").option("header", "true").csv(f"{path.rstrip('/')}_candidates")


def stage_paths(manifest: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Distinct files a manifest names: matched ones, and every candidate of an ambiguous name.

    Candidates come from the candidate table, or from a ``|``-joined ``candidate_paths`` column.
    """
    parts = [manifest.where("status = 'matched' and relative_path <> ''").select("relative_path")]
    if "candidate_paths" in manifest.columns:
        parts.append(manifest.where("status = 'ambiguous' and candidate_paths <> ''").select(
            F.explode(F.split("candidate_paths", r"\|")).alias("relative_path")))
    if candidates is not None:
        parts.append(candidates.select("relative_path"))
    return reduce(DataFrame.unionByName, parts).distinct()


def stage_summary(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Number and total bytes of the staged files. ``files``: relative_path, length."""
    return paths.join(files, "relative_path", "left").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("length").isNull()).alias("missing"),
    )


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, sha256) of every file below ``root`` but empty ones; contents are read in ranges."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return with_digests(files).select(
        F.substr(plain(F.col("path")), F.length(plain(F.lit(base))) + 1).alias("file"), F.col("length").alias("bytes"), "sha256",
    )


def table_counts(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, rows) of the snapshot's tables, in two passes."""
    per_slug = catalog.groupBy("slug").agg(
        F.count(F.lit(1)).alias("n"), F.count("description_text_embedding").alias("v")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("catalog"), F.count("slug").alias("slugs"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("text_embeddings"),
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("rows")) for c in ("catalog", "slugs", "text_embeddings")
    ])).alias("r")
    images = refs.agg(F.lit("reference_images").alias("name"), F.count(F.lit(1)).alias("rows"))
    return per_slug.select(rows).select("r.*").unionByName(images)


def snapshot_manifest(
    spark: SparkSession, root: str, catalog: DataFrame, refs: DataFrame, excluded: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Files with digests, table counts, model inventory and proof that excluded tables are empty."""
    from shelfmatch.operators.aggregates import model_inventory
    from shelfmatch.operators.validate import catalog_scope_filter, private_tables

    scoped = catalog_scope_filter(refs)
    return {
        "files": file_manifest(spark, root), "counts": table_counts(catalog, scoped),
        "models": model_inventory(scoped, catalog), "excluded": private_tables(excluded),
    }


def photo_files(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, length) of files below ``root`` for ``match_photo_names``."""
    base = root.rstrip("/") + "/"
    return files.select(F.substr("path", F.lit(len(base) + 1)).alias("relative_path"), "length").where(
        X.base_name(F.col("relative_path")) != ""
    )
