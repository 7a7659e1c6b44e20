"""Checks and derived columns. Row checks never stop a job: they return good and problem rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import paths
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.skew import first_per_key


def split_problems(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("problem", problem)
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull())


def problem_report(problems: DataFrame, shown: int = K.MAX_REPORTED_PROBLEMS) -> DataFrame:
    """The first problems by line; the whole list stays in ``problems``."""
    return problems.orderBy("line", "problem").limit(shown)


def validate_reference_manifest(
    df: DataFrame, root: str, uri: str = "image_uri", item: str | None = "item_id", slug: str = "slug"
) -> tuple[DataFrame, DataFrame]:
    """Paths inside ``root``, unique photos, one slug per item; each row shows its first problem.

    First occurrences come from pre-aggregated minima, so a photo repeated in a third of the rows
    is no hot window.
    """
    checked = df.withColumn("__path", paths.container_path_problem(F.col(uri), root))
    valid = checked.where(F.col("__path").isNull())
    first_line = valid.groupBy(uri).agg(F.min("line").alias("__first"))
    marked = checked.join(first_line, uri, "left")
    duplicate = F.col("__path").isNull() & (F.col("line") > F.col("__first"))
    problem = F.when(F.col("__path").isNotNull(), F.concat(F.lit(f"{uri} "), "__path", F.lit(": "), uri)).when(
        duplicate, F.concat(F.lit(f"duplicate {uri} "), uri, F.lit(" (first on line "), "__first", F.lit(")"))
    )
    if item is not None:
        kept = valid.join(first_line, uri).where(F.col("line") == F.col("__first"))
        known = kept.groupBy(item).agg(
            F.min_by(slug, "line").alias("__slug"), F.min("line").alias("__slug_line")
        )
        marked = marked.join(known, item, "left")
        problem = problem.when(
            F.col(slug) != F.col("__slug"),
            F.concat(
                F.lit("item "), item, F.lit(" has slug "), slug, F.lit(", but line "), "__slug_line",
                F.lit(" has slug "), "__slug",
            ),
        )
    good, bad = split_problems(marked, problem)
    return good.select(*df.columns), bad.select(*df.columns, "problem")


def validate_eval_queries(df: DataFrame, root: str, uri: str = "query_image_uri") -> tuple[DataFrame, DataFrame]:
    return validate_reference_manifest(df, root, uri=uri, item=None)


def validate_image_meta(
    files: DataFrame, root: str, suffixes: list[str] = K.UPLOAD_SUFFIXES, max_bytes: int = K.MAX_IMAGE_BYTES
) -> DataFrame:
    """Adds ``problem``: outside the root, unsupported suffix or too large."""
    path = F.col("path")
    return files.withColumn(
        "problem",
        F.when(~paths.inside(paths.normalize_path(path), root), "outside_root")
        .when(~X.file_suffix(path).isin(suffixes), "unsupported_format")
        .when(F.col("length") > max_bytes, "too_large"),
    )


def validate_vectors(df: DataFrame, dim: int, model: str, vector: str = "embedding",
                     model_col: str = "model_name") -> DataFrame:
    return df.withColumn("problem", N.vector_problem(F.col(vector), F.col(model_col), dim, model))


def validate_scores(
    scores: DataFrame, shortlist: DataFrame | None = None, low: float = 0.0, high: float = 1.0,
    id_col: str = "item_id",
) -> tuple[DataFrame, DataFrame]:
    """Present id, finite score in range, and an id of the query's shortlist."""
    missing = F.coalesce(F.col(id_col).cast("string"), F.lit("")) == ""
    valid = F.coalesce(N.is_finite(F.col("score")) & F.col("score").between(low, high), F.lit(False))
    problem = F.when(missing, "missing_id").when(~valid, "invalid_score")
    df = scores
    if shortlist is not None:
        listed = shortlist.select("query_id", id_col).distinct().withColumn("__listed", F.lit(True))
        df = df.join(listed, ["query_id", id_col], "left")
        problem = problem.when(F.col("__listed").isNull(), "outside_shortlist")
    good, bad = split_problems(df, problem)
    return good.select(*scores.columns), bad.select(*scores.columns, "problem")


def validate_shortlist(candidates: DataFrame, limit: int = K.SHORTLIST_LIMIT) -> DataFrame:
    """One row per query with the first reason its visual shortlist is unusable, or NULL."""
    score = F.col("score")
    invalid = ~F.coalesce(N.is_finite(score) & score.between(-1, 1), F.lit(False))
    per_id = candidates.groupBy("query_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(invalid).alias("bad"),
        F.count_if(F.coalesce(F.col("slug"), F.lit("")) == "").alias("blank"),
        F.min("slug").alias("slug"), F.max("slug").alias("slug2"),
    )
    # Copies of one id are already one row here, so a hot query is small before the next step.
    per_slug = per_id.groupBy("query_id", "slug").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("blank").alias("blank")
    )
    return per_slug.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("copies"), F.sum("bad").alias("bad"),
        F.sum("blank").alias("blank"),
    ).select(
        "query_id",
        F.when(F.col("n") > limit, "too_many_candidates").when(F.col("copies") > 1, "duplicate_candidate")
        .when(F.col("blank") > 0, "invalid_slug").when(F.col("bad") > 0, "invalid_score").alias("problem"),
    )


def validate_ranking_output(ranking: DataFrame, limit: int = K.BRANCH_LIMIT) -> DataFrame:
    """One row per query: size, numeric ids, scores in range, order; NULL problem when sound.

    The order check joins each position to the one before it, so no ranking is sorted in one task.
    """
    score = F.col("score")
    invalid = ~F.coalesce(N.is_finite(score) & score.between(0, 1), F.lit(False))
    before = ranking.select(
        "query_id", (F.col("position") + 1).alias("position"), F.col("score").alias("__before")
    )
    return ranking.join(before, ["query_id", "position"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~F.col("item_id").cast("string").rlike("^[0-9]+$")).alias("bad_id"),
        F.count_if(invalid).alias("bad_score"),
        F.count_if(score > F.col("__before")).alias("bad_order"),
    ).select(
        "query_id", "candidates",
        F.when(F.col("candidates") > limit, "too_many").when(F.col("bad_id") > 0, "non_numeric_id")
        .when(F.col("bad_score") > 0, "invalid_score").when(F.col("bad_order") > 0, "not_sorted")
        .alias("problem"),
    )


def explicit_vintage(name: Column, slug: Column) -> Column:
    """The year in name and slug when there is exactly one."""
    years = F.array_distinct(X.extract_years(F.concat_ws(" ", F.coalesce(name, F.lit("")), slug)))
    return F.when(F.size(years) == 1, years[0].try_cast("int"))


def make_card(wines: DataFrame) -> DataFrame:
    """Public card: trimmed attributes, explicit vintage, safe photo location, other attributes."""
    photo = F.col("web_photo")
    safe = photo.isNotNull() & ~photo.rlike(r"[/\\]") & ~photo.isin("", ".")
    extra = F.map_filter(
        "source_data", lambda k, v: ~k.isin(K.KNOWN_CARD_LABELS) & X.clean_value(v).isNotNull()
    )
    return wines.select(
        "slug",
        *[F.coalesce(X.clean_value(F.col(f)), F.lit("")).alias(f) for f in K.CATALOG_FIELDS],
        explicit_vintage(F.trim("name"), F.col("slug")).alias("vintage"),
        F.when(safe, F.concat(F.lit(K.WEB_PHOTO_PREFIX), photo)).alias("web_photo_uri"),
        F.transform(F.map_entries(extra), lambda e: F.struct(
            e["key"].alias("label"), X.clean_value(e["value"]).alias("value")
        )).alias("attributes"),
    )


def pending_embeddings(
    wines: DataFrame, jobs: DataFrame, kind: str, model: str, retry_failed: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Rows whose vector of this kind is missing or made by another model."""
    vector, used = F.col(f"{kind}_embedding"), F.col(f"{kind}_embedding_model")
    pending = wines.where(vector.isNull() | ~used.eqNullSafe(F.lit(model)))
    if kind in ("dataset_photo", "web_photo"):
        pending = pending.where(F.col(kind).isNotNull())
    if retry_failed:
        failed = jobs.where((F.col("kind") == kind) & (F.col("status") == "failed"))
        pending = pending.join(failed, pending["id"] == failed["item_row_id"], "left_semi")
    pending = pending.orderBy("id")
    return pending if limit is None else pending.limit(limit)


def pending_scrapes(
    wines: DataFrame, jobs: DataFrame, slugs: DataFrame | None = None, retry_failed: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Distinct catalog slugs without a finished page job, or only those that failed.

    A requested slug that the catalog lacks is an error, raised when its row is read.
    """
    known = wines.where(X.clean_value(F.col("slug")).isNotNull()).select("slug").distinct()
    if slugs is not None:
        asked = slugs.select("slug").where(F.col("slug").isNotNull()).distinct()
        marked = asked.join(known.withColumn("__known", F.lit(True)), "slug", "left")
        missing = F.raise_error(F.concat(F.lit("The catalog has no slug "), "slug"))
        known = marked.select(F.coalesce(F.when(F.col("__known"), F.col("slug")), missing.cast("string")).alias("slug"))
    if retry_failed:
        pending = known.join(jobs.where("status = 'failed'"), "slug", "left_semi")
    else:
        pending = known.join(jobs.where("status = 'succeeded'"), "slug", "left_anti")
    pending = pending.orderBy("slug")
    return pending if limit is None else pending.limit(limit)


def catalog_scope_filter(refs: DataFrame, prefix: str = K.CATALOG_PREFIX) -> DataFrame:
    return refs.where(F.col("image_uri").startswith(prefix))


def private_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table that a snapshot must leave empty."""
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).withColumn(
        "problem", F.when(F.col("rows") > 0, "private_data_remains")
    )


def index_health(refs: DataFrame, model: str, dim: int) -> DataFrame:
    """Counts and width of the reference vectors against the expected model and width."""
    mine = F.col("model_name") == model
    summary = refs.agg(
        F.count(F.lit(1)).alias("reference_images"), F.count_if(mine).alias("model_reference_images"),
        F.min(F.size("embedding")).alias("min_dimension"), F.max(F.size("embedding")).alias("max_dimension"),
    )
    right = (F.col("min_dimension") == dim) & (F.col("max_dimension") == dim)
    return summary.withColumn(
        "status",
        F.when(F.col("reference_images") == 0, "ok").when(right, "ok").otherwise("error"),
    )


def feature_keys(images: DataFrame, signature: str, config: str) -> DataFrame:
    head = F.encode(F.lit(f"{signature}\x1f{config}\x1f"), "utf-8")
    return images.withColumn("feature_key", F.sha2(F.concat(head, "content"), 256))


def incremental_features(images: DataFrame, features: DataFrame, signature: str, config: str) -> DataFrame:
    """Distinct inputs whose features are not stored under this model, configuration and content."""
    keyed = feature_keys(images, signature, config)
    fresh = keyed.join(features.select("feature_key"), "feature_key", "left_anti")
    return first_per_key(fresh, ["feature_key"], [F.col("image_uri")])


def display_fields(ranked: DataFrame, card_url: str) -> DataFrame:
    """Percent, shown name and card address of every candidate."""
    words = F.trim(F.regexp_replace("slug", "[-_]+", " "))
    pretty = F.when(words == "", F.lit("Без названия")).otherwise(
        F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    )
    percent = F.floor(F.col("score") * 100 + F.lit(0.5)).cast("int")
    return ranked.withColumns({
        "percent": F.greatest(F.lit(0), F.least(F.lit(100), percent)),
        "display_name": F.coalesce(F.nullif(F.col("name"), F.lit("")), pretty),
        "item_url": F.concat(F.lit(card_url.rstrip("/") + "/"), paths.quote_path(F.col("slug"))),
    })


def split_leakage(samples: DataFrame) -> DataFrame:
    """Problems of a benchmark sample table: ids, splits, and series that cross splits."""
    sample, series = F.col("sample_id"), F.col("series_id")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rows = samples.select(
        F.coalesce(sample, F.lit("")).alias("subject"),
        F.when(blank(sample), "empty_sample_id").when(~F.col("split").isin("tuning", "test"), "unknown_split")
        .when(blank(series), "empty_series_id").alias("problem"),
    ).where("problem is not null")
    repeated = samples.groupBy(sample.alias("subject")).count().where("count > 1").select(
        "subject", F.lit("duplicate_sample_id").alias("problem")
    )
    crossing = samples.groupBy(series.alias("subject")).agg(
        F.min("split").alias("a"), F.max("split").alias("b")
    ).where("a <> b").select("subject", F.lit("series_crosses_splits").alias("problem"))
    return rows.unionByName(repeated).unionByName(crossing)


def smoke_gate(results: DataFrame) -> DataFrame:
    """Adds ``problem``: the first reason a recognised query is not a complete match."""
    return results.withColumn(
        "problem",
        F.when(F.col("state") != "done", "not_finished")
        .when(F.col("expected_slug").isNotNull() & (F.col("slug") != F.col("expected_slug")), "unexpected_slug")
        .when(F.size("warnings") > 0, "degraded")
        .when((F.col("visual_count") == 0) | (F.col("geometry_count") == 0), "visual_branch_missing")
        .when(F.col("text_count") == 0, "text_branch_missing"),
    )
