"""Incremental maintenance of the catalog, job and reference tables.

Each operator returns the next version of a table. Parquet has no row updates, so a caller writes
the result as a new version (``sources.tables``) and never overwrites the path it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.operators.aggregates import indexing_stats
from shelfmatch.operators.joins import prune_candidates
from shelfmatch.operators.sets import photo_kinds_union
from shelfmatch.operators.windows import canonical_id, first_occurrence
from shelfmatch.skew import first_per_key, range_rank

KEY = ["import_source", "source_row_number"]
SOURCE_COLUMNS = [*K.CATALOG_FIELDS, "slug", "dataset_photo", "source_data"]
KINDS = ("dataset_photo", "description_text", "web_photo")


def _changed(columns: list[str]) -> Column:
    """Null-safe difference of any of the columns between the two sides."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"i.{c}"))
    return ~same


def _new_ids(new_rows: DataFrame, current: DataFrame, order: list[Column]) -> DataFrame:
    """Dense ids after the largest one in use."""
    largest = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = range_rank(new_rows, order, "__n")
    return numbered.withColumn("id", F.col("__n") + largest).drop("__n")


def upsert_catalog(current: DataFrame, incoming: DataFrame, described: list[str] = K.CATALOG_FIELDS) -> DataFrame:
    """Merge imported rows by (source, row number).

    A stored vector is dropped only when its own input changed: the photo name, any of the attributes
    that its text was made of (``described``: all seven, unless a catalog embeds fewer), or the slug
    (web photo).
    """
    joined = current.withColumn("__c", F.lit(True)).alias("c").join(
        incoming.withColumn("__i", F.lit(True)).alias("i"), KEY, "full"
    )
    has_c, has_i = F.col("c.__c").isNotNull(), F.col("i.__i").isNotNull()
    take = lambda c: F.when(has_i, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}"))
    resets = {
        "dataset_photo": _changed(["dataset_photo"]), "description_text": _changed(described),
        "web_photo": _changed(["slug"]),
    }
    keep = lambda c, reset: F.when(has_i & reset, F.lit(None)).otherwise(F.col(f"c.{c}")).alias(c)
    merged = joined.select(
        *KEY, F.col("c.id").alias("id"), *[take(c).alias(c) for c in SOURCE_COLUMNS],
        keep("web_photo", resets["web_photo"]), keep("web_photo_url", resets["web_photo"]),
        *[keep(f"{k}_embedding{m}", resets[k]) for k in KINDS for m in ("", "_model")],
        (has_c).alias("__known"),
    )
    known = merged.where("__known").drop("__known")
    fresh = _new_ids(
        merged.where("not __known").drop("__known"), current, [F.col("source_row_number"), F.col("import_source")],
    )
    return known.unionByName(fresh).select(*current.columns)


def trim_source_tail(current: DataFrame, source_id: str, last_row: int) -> DataFrame:
    """Drop rows past the end of a source that became shorter."""
    return current.where((F.col("import_source") != source_id) | (F.col("source_row_number") <= last_row))


def apply_scrape_result(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Set the web photo on every row of a slug; its vector goes when photo or address changed.

    A slug with several pages takes the one whose photo and address come first in order, so that no
    catalog row is multiplied; nulls come last.
    """
    order = F.struct(*[f(F.col(c)) for c in ("web_photo", "web_photo_url") for f in (F.isnull, F.coalesce)])
    found = pages.groupBy("slug").agg(F.min_by(F.struct("web_photo", "web_photo_url"), order).alias("p")).select(
        "slug", F.col("p.web_photo").alias("__photo"), F.col("p.web_photo_url").alias("__url"), F.lit(True).alias("__hit")
    )
    joined = catalog.join(found, "slug", "left")
    hit = F.col("__hit").isNotNull()
    differs = hit & ~(F.col("web_photo").eqNullSafe(F.col("__photo")) & F.col("web_photo_url").eqNullSafe(F.col("__url")))
    return joined.withColumns({
        "web_photo_embedding": F.when(~differs, F.col("web_photo_embedding")),
        "web_photo_embedding_model": F.when(~differs, F.col("web_photo_embedding_model")),
        "web_photo": F.when(hit, F.col("__photo")).otherwise(F.col("web_photo")),
        "web_photo_url": F.when(hit, F.col("__url")).otherwise(F.col("web_photo_url")),
    }).select(*catalog.columns)


def settle_scrapes(catalog: DataFrame, jobs: DataFrame, pages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Catalog and job table after pages were read: photos set, and the jobs of their slugs done.

    Both come from the same pages, so a writer that publishes the two together never shows one without
    the other. ``jobs``: slug, status, attempts, last_error, processed_at, updated_at. A slug without a job
    gets none, a job without a page stays as it is.
    """
    read = pages.select("slug", F.lit(True).alias("__read")).distinct()
    done = F.col("__read").isNotNull()
    settled = jobs.join(read, "slug", "left").withColumns({
        "status": F.when(done, "succeeded").otherwise(F.col("status")), "last_error": F.when(~done, F.col("last_error")),
        "processed_at": F.when(done, now).otherwise(F.col("processed_at")), "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)
    return apply_scrape_result(catalog, pages), settled


def track_jobs(jobs: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge attempts into the job table: attempts added up, last status, error cut and cleared.

    ``jobs``: keys, status, attempts, last_error, updated_at; ``outcomes``: keys, status, error, ts.
    """
    latest = outcomes.groupBy(*keys).agg(
        F.max_by(F.struct("status", "error"), "ts").alias("o"), F.count(F.lit(1)).alias("__tries"), F.max("ts").alias("ts")
    )
    joined = jobs.join(latest, keys, "full")
    tried = F.col("o").isNotNull()
    error = F.when(F.col("o.status") == "failed", F.substring("o.error", 1, K.MAX_ERROR_CHARS))
    return joined.select(
        *keys, F.when(tried, F.col("o.status")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("__tries", F.lit(0))).cast("int").alias("attempts"),
        F.when(tried, error).otherwise(F.col("last_error")).alias("last_error"),
        F.coalesce("ts", "updated_at").alias("updated_at"),
    )


def store_vectors(catalog: DataFrame, vectors: DataFrame, kind: str, model: str) -> DataFrame:
    """Write computed vectors of one kind. ``vectors``: id, embedding."""
    if kind not in KINDS:
        raise ValueError(f"unknown vector kind {kind}")
    column = f"{kind}_embedding"
    joined = catalog.join(vectors.select("id", F.col("embedding").alias("__v")), "id", "left")
    done = F.col("__v").isNotNull()
    return joined.withColumns({
        column: F.coalesce("__v", column),
        f"{column}_model": F.when(done, F.lit(model)).otherwise(F.col(f"{column}_model")),
    }).select(*catalog.columns)


def catalog_references(catalog: DataFrame, manifest: DataFrame, model: str, dim: int, root: str) -> DataFrame:
    """Reference rows of the catalog's own photos under canonical item ids.

    A vector of another width, or a dataset photo without a matched file, fails the run.
    """
    named = catalog.where(F.coalesce(F.col("slug"), F.lit("")) != "")
    canonical = canonical_id(named.select("id", "slug")).select("id", "canonical_id")
    stacked = photo_kinds_union(named.select(
        "id", "slug", "dataset_photo", "web_photo",
        *[F.col(f"{k}_photo_embedding{m}") for k in ("dataset", "web") for m in ("", "_model")],
    )).where(F.col("embedding").isNotNull() & (F.col("model_name") == model))
    placed = stacked.join(canonical, "id").join(
        manifest.select(F.col("dataset_photo").alias("photo"), F.col("relative_path").alias("__file")), "photo", "left"
    )
    relative = F.when(
        F.col("kind") == "dataset", F.concat(F.lit("exports/dataset_photos/"), F.coalesce(
            F.col("__file"), F.raise_error(F.concat(F.lit("No matched file for "), F.col("photo")))))
    ).otherwise(F.concat(F.lit("web_photos/"), X.base_name(F.col("photo"))))
    rows = placed.withColumn("__rel", relative).select(
        "id", F.col("canonical_id").cast("string").alias("item_id"), "slug",
        F.concat(
            F.lit(f"{root.rstrip('/')}/reference/catalog/"), F.col("canonical_id").cast("string"), F.lit("/"), "kind",
            F.lit("-"), F.substring(F.sha2("__rel", 256), 1, 16), X.file_suffix(F.col("__rel")),
        ).alias("image_uri"),
        F.lit(model).alias("model_name"),
        F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
            F.raise_error(F.concat(F.lit("Wrong vector dimension for "), "slug"))).alias("embedding"),
    )
    return first_per_key(rows, ["image_uri"], [-F.col("id")]).drop("id")


def publish_references(
    catalog: DataFrame, manifest: DataFrame, refs: DataFrame, model: str, dim: int, root: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Upsert the catalog's reference rows; an empty publication is refused."""
    incoming = catalog_references(catalog, manifest, model, dim, root)
    if incoming.select("image_uri").isEmpty():
        raise ValueError("No compatible catalog image vectors; refusing empty publication")
    return upsert_references(refs, incoming, now)


def upsert_references(refs: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Merge references by photo; returns the new table and (image_uri, outcome) rows.

    ``incoming``: item_id, slug, image_uri (unique), model_name, embedding.
    """
    values = ["item_id", "slug", "model_name", "embedding"]
    joined = refs.withColumn("__c", F.lit(True)).alias("c").join(
        incoming.withColumn("__i", F.lit(True)).alias("i"), "image_uri", "full"
    )
    has_c, has_i = F.col("c.__c").isNotNull(), F.col("i.__i").isNotNull()
    merged = joined.select(
        "image_uri", F.col("c.id").alias("id"),
        *[F.when(has_i, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in values],
        F.coalesce(F.col("c.created_at"), now).alias("created_at"),
        F.when(has_i, now).otherwise(F.col("c.updated_at")).alias("updated_at"), has_c.alias("__known"),
    )
    digest = F.md5("image_uri")
    fresh = _new_ids(
        merged.where("not __known").drop("__known"), refs, [digest, F.col("image_uri")],
    )
    table = merged.where("__known").drop("__known").unionByName(fresh).select(*refs.columns)
    known = refs.select("image_uri", F.lit(True).alias("__c"))
    outcomes = incoming.select("image_uri").join(known, "image_uri", "left").select(
        "image_uri", F.when(F.col("__c"), "updated").otherwise("inserted").alias("outcome")
    )
    return table, outcomes


def index_run(
    refs: DataFrame, source: DataFrame, model: str, now: Column, prune: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Index embedded photos; returns the new table and one row of run statistics.

    ``source``: position, item_id, slug, image_uri, path, model_name, embedding, error. Failed rows
    are counted and never stop the run. Pruning drops same-model references that the source no
    longer names, keeps those whose photo failed, and does nothing when no photo succeeded.
    """
    failed = source.where(F.col("error").isNotNull())
    kept, skipped = first_occurrence(source.where(F.col("error").isNull()))
    incoming = kept.select("item_id", "slug", F.col("path").alias("image_uri"), "model_name", "embedding")
    table, outcomes = upsert_references(refs, incoming, now)
    rows = outcomes.select("outcome").unionByName(
        skipped.select(F.lit("skipped").alias("outcome"))
    ).unionByName(failed.select(F.lit("error").alias("outcome")))
    if prune:
        keep = incoming.select("image_uri").unionByName(failed.select("image_uri")).unionByName(
            failed.select(F.col("path").alias("image_uri")))
        processed = incoming.agg(F.count(F.lit(1)).alias("n")).scalar()
        deleted = prune_candidates(table, keep, model).where(processed > 0).select("image_uri")
        table = table.join(deleted, "image_uri", "left_anti").select(*refs.columns)
        rows = rows.unionByName(deleted.select(F.lit("deleted").alias("outcome")))
    return table, indexing_stats(rows)
