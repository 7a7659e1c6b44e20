"""Exact de-duplication by a tree merge of sorted digest runs (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm.common import BLANK_RUN, saved, table, text_or_empty

#: What two rows must share to count as one text: the digest, and two checks that verify it.
DIGEST = ["__digest", "__chars", "__check"]


def normalized(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANK_RUN, " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id and digest of the normalised text."""
    return df.select(F.col(id_col).alias("__id"), normalized(text_col).alias("__norm")).select(
        "__id",
        F.unhex(F.sha2("__norm", 256)).alias("__digest"),
        F.length("__norm").cast("long").alias("__chars"),
        F.xxhash64("__norm").alias("__check"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Merge ``fan_in`` neighbouring runs into one; equal texts keep the smallest identifier."""
    return (
        runs.withColumn("__run", F.floor(F.col("__run") / fan_in))
        .groupBy("__run", *DIGEST)
        .agg(F.min("__keep").alias("__keep"), F.sum("__size").alias("__size"))
    )


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """Group rows whose texts are equal after each run of blanks becomes one space.

    Rows are dealt into ``runs`` by identifier. A run is the grouped (sorted and combined) digests
    of its rows. Every round merges ``fan_in`` neighbouring runs by digest and keeps the smallest
    identifier and the group size, until one run is left, itself spread over tasks by digest. The
    answers then go down the tree: a row meets its own run's entry, so a group that owns a third
    of the rows is spread over ``runs`` keys and reaches each as a combined row.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Null texts
    count as empty. Null identifiers come after all others: they are kept only if the whole group
    has none. Of rows that repeat both identifier and text, one is kept. Other columns are not read.
    """
    rows = saved(
        digests(df, id_col, text_col)
        .groupBy("__id", *DIGEST).agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__run", F.pmod(F.xxhash64("__id", "__check"), F.lit(runs)))
    )
    level = rows.groupBy("__run", *DIGEST).agg(
        F.min("__id").alias("__keep"), F.sum("__copies").alias("__size")
    )
    levels, width = [saved(level)], runs
    while width > 1:
        levels.append(saved(merge_round(levels[-1], fan_in)))
        width = -(-width // fan_in)
    answers = levels.pop().select("__run", *DIGEST, "__keep", "__size")
    while levels:
        below = levels.pop().select("__run", *DIGEST).withColumn("__up", F.floor(F.col("__run") / fan_in))
        answers = below.join(
            answers.withColumnRenamed("__run", "__up"), ["__up", *DIGEST]
        ).select("__run", *DIGEST, "__keep", "__size")
    return rows.join(answers, ["__run", *DIGEST]).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    ).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1)).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w
    AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
  text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
