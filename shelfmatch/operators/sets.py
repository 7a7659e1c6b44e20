"""Set algebra over slugs, ids and photo kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmatch.operators.joins import unknown_ids

__all__ = ["supported_slugs", "missing_and_unexpected", "photo_kinds_union", "unknown_ids"]


def supported_slugs(visual: DataFrame, text: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Slugs with a visual or text score that are in the query's shortlist."""
    keys = ["query_id", "slug"]
    scored = visual.select(*keys).union(text.select(*keys)).distinct()
    return scored.join(shortlist.select(*keys), keys, "left_semi")


def missing_and_unexpected(expected: Column, observed: Column) -> Column:
    """Struct of sorted arrays found, missing and unexpected."""
    return F.struct(
        F.array_sort(F.array_intersect(expected, observed)).alias("found"),
        F.array_sort(F.array_except(expected, observed)).alias("missing"),
        F.array_sort(F.array_except(observed, expected)).alias("unexpected"),
    )


def photo_kinds_union(catalog: DataFrame) -> DataFrame:
    """Dataset and web photos of the catalog as rows of one table, in one pass."""
    return catalog.select("id", "slug", F.explode(F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.col(f"{kind}_photo").alias("photo"),
            F.col(f"{kind}_photo_embedding").alias("embedding"),
            F.col(f"{kind}_photo_embedding_model").alias("model_name"),
        ) for kind in ("dataset", "web")
    ])).alias("p")).select("id", "slug", "p.*")
