"""Counts, rates, reports and palettes. All group sizes are unbounded; all partials are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators.joins import pair_variants
from shelfmatch.skew import quantile_band


def list_items(refs: DataFrame, model: str) -> DataFrame:
    """Photos of every item in (item, uri) order, with the item's smallest slug.

    One row per photo: an item with very many photos is spread by the range sort instead of being
    collected into one array.
    """
    mine = refs.where(F.col("model_name") == model)
    slugs = mine.groupBy("item_id").agg(F.min("slug").alias("item_slug"))
    return mine.join(slugs, "item_id").select("item_id", F.col("item_slug").alias("slug"), "image_uri").orderBy(
        "item_id", "image_uri"
    )


def reference_counts(refs: DataFrame) -> DataFrame:
    """Photos and distinct items per model."""
    per_item = refs.groupBy("model_name", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("model_name").agg(F.sum("n").alias("photos"), F.count(F.lit(1)).alias("items"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    state = F.col("embedding_state")
    return feedback.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"),
        F.count_if(~F.col("is_correct")).alias("incorrect"),
        F.count("correct_slug").alias("labeled"),
        F.count_if(F.col("review_status") == "pending").alias("pending_review"),
        F.count_if(state == "ready").alias("indexed"),
        F.count_if(state.isin("queued", "indexing")).alias("indexing"),
        F.count_if(state == "failed").alias("index_failed"),
    )


def recall_at_k(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, correct, recall) over processed queries; recall is NULL without any."""
    levels = sorted(set(ks))
    counts = ranks.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"c{k}") for k in levels]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("correct")) for k in levels
    ])).alias("r")
    recall = F.when(F.col("n") > 0, F.bround(F.col("r.correct") / F.col("n"), 4))
    return counts.select("n", rows).select("r.k", "r.correct", recall.alias("recall"))


def run_status(processed: Column, errors: Column) -> Column:
    return F.when(errors == 0, "ok").when(processed > 0, "partial").otherwise("failed")


def evaluation_report(ranks: DataFrame, errors: DataFrame, top_k: int) -> DataFrame:
    """One row of totals; misses are the rows of ``evaluation_misses``."""
    rows = ranks.select(
        F.lit(1).alias("done"), F.coalesce((F.col("rank") <= top_k).cast("int"), F.lit(0)).alias("hit"),
        F.lit(0).alias("error"),
    ).unionByName(errors.select(F.lit(0).alias("done"), F.lit(0).alias("hit"), F.lit(1).alias("error")))
    n, e, c = F.col("queries_processed"), F.col("queries_with_errors"), F.col("correct_queries")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return rows.agg(
        total("done").alias("queries_processed"), total("error").alias("queries_with_errors"),
        total("hit").alias("correct_queries"),
    ).select(
        run_status(n, e).alias("status"), (n + e).alias("queries_total"), n, e, c,
        F.when(n > 0, F.bround(c / n, 4)).alias("recall_at_k"), F.lit(top_k).alias("top_k"),
    )


def evaluation_misses(ranks: DataFrame, ranked: DataFrame, top_k: int, item: str = "item_id") -> DataFrame:
    """Queries whose item is not in the first ``top_k``, with what was predicted instead."""
    from shelfmatch.operators.ranking import top_ids

    missed = ranks.where(F.col("rank").isNull() | (F.col("rank") > top_k))
    predicted = top_ids(ranked, top_k, item)
    return missed.join(predicted, "query_id", "left").select(
        "query_id", "expected", F.col("rank").alias("expected_rank"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("predicted"),
    )


def mean_rank_recall(metrics: DataFrame, by: list[str] = ["variant"]) -> DataFrame:
    rank = F.col("rank")
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(rank).alias("mean_rank"),
        F.avg((rank <= 1).cast("int")).alias("recall_at_1"), F.avg((rank <= 5).cast("int")).alias("recall_at_5"),
    )


EXACT = ("name", "producer", "year", "all")


def ocr_quality(metrics: DataFrame, by: list[str] = ["variant"]) -> DataFrame:
    """Mean character error rate and exact-match rates; ``metrics`` has cer and exact_* columns."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("cer").alias("cer"),
        *[F.avg(F.col(f"exact_{f}").cast("int")).alias(f"exact_{f}") for f in EXACT],
    )


def paired_degradation(metrics: DataFrame, value: str, lower_is_better: bool, baseline: str = "A") -> DataFrame:
    """Per variant: pairs with the baseline, pairs that got worse, and their rate."""
    pairs = pair_variants(metrics, value, baseline)
    a, b = F.col("baseline"), F.col("candidate")
    worse = F.count_if(b > a) if lower_is_better else F.count_if(b < a)
    return pairs.groupBy("variant").agg(
        F.lit(value).alias("metric"), F.count(F.lit(1)).alias("count"), worse.alias("degraded")
    ).withColumn("rate", F.col("degraded") / F.col("count"))


def degradation_report(metrics: DataFrame, values: dict[str, bool], baseline: str = "A") -> DataFrame:
    """Degradation of several metrics (name -> lower is better) with one join to the baseline."""
    packed = F.struct(*[F.col(v).cast("double").alias(v) for v in values])
    pairs = pair_variants(metrics.withColumn("__m", packed), "__m", baseline)
    worse = {
        v: (F.col(f"candidate.{v}") > F.col(f"baseline.{v}")) if low
        else (F.col(f"candidate.{v}") < F.col(f"baseline.{v}")) for v, low in values.items()
    }
    per = pairs.groupBy("variant").agg(
        *[F.count_if(w).alias(f"w_{v}") for v, w in worse.items()],
        *[F.count_if(w.isNotNull()).alias(f"n_{v}") for v, w in worse.items()],
    )
    rows = F.explode(F.array(*[F.struct(
        F.lit(v).alias("metric"), F.col(f"n_{v}").alias("count"), F.col(f"w_{v}").alias("degraded")
    ) for v in values])).alias("r")
    return per.select("variant", rows).select("variant", "r.*").where("count > 0").withColumn(
        "rate", F.col("degraded") / F.col("count")
    )


def quality_by_condition(ocr: DataFrame, retrieval: DataFrame) -> DataFrame:
    """OCR and retrieval quality per (condition, variant)."""
    tag = lambda df: df.withColumn("condition", F.explode("conditions"))
    by = ["condition", "variant"]
    left = ocr_quality(tag(ocr), by).withColumnRenamed("count", "ocr_count")
    right = mean_rank_recall(tag(retrieval), by).withColumnRenamed("count", "retrieval_count")
    return left.join(right, by, "full")


def variant_status(statuses: DataFrame) -> DataFrame:
    """Status and counts per variant; ``status_counts`` maps status to count."""
    counts = statuses.groupBy("variant", "status").agg(F.count(F.lit(1)).alias("n"))
    # One entry per distinct status.
    per = counts.groupBy("variant").agg(
        F.sum("n").alias("sample_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n"))), F.lit(0)).alias("available_count"),
        F.count(F.lit(1)).alias("__kinds"), F.min("status").alias("__only"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
    )
    return per.select(
        "variant",
        F.when(F.col("available_count") == F.col("sample_count"), "ok")
        .when(F.col("available_count") > 0, "partial").when(F.col("__kinds") == 1, F.col("__only"))
        .otherwise("not_run").alias("status"),
        "sample_count", "available_count", "status_counts",
    )


def exact_percentiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] = [], bands: int = 64
) -> DataFrame:
    """Exact linearly interpolated percentiles without one task per group.

    Equal values are counted before the shuffle, then numbered inside ``bands`` bands
    of like size, cut at quantiles of the values; only the order statistics around each quantile are kept.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    counts = counts.withColumn("__band", quantile_band(counts, F.col("__v"), bands))
    key = [*by, "__band"]
    across = Window.partitionBy(*by).orderBy("__band")
    bands = counts.groupBy(*key).agg(F.sum("__n").alias("__bn")).select(
        *[F.col(k).alias(f"__k_{k}") for k in key],
        F.coalesce(F.sum("__bn").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__bn").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    inside = Window.partitionBy(*key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key])
    placed = counts.withColumn("__upto", F.sum("__n").over(inside)).join(bands, match)
    end = F.col("__before") + F.col("__upto")
    start = end - F.col("__n")
    out = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("__total") - 1)
        for part, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            out.append(F.max(F.when((start <= place) & (place < end), F.col("__v"))).alias(f"__{name}_{part}"))
    stats = placed.groupBy(*by).agg(F.max("__total").alias("count"), *out)
    interpolated = [
        (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * (
            F.lit(q) * (F.col("count") - 1) - F.floor(F.lit(q) * (F.col("count") - 1)))).alias(n)
        for n, q in quantiles.items()
    ]
    return stats.select(*by, "count", *interpolated)


def latency_percentiles(timings: DataFrame, by: list[str] = [], value: str = "ms", bands: int = 64) -> DataFrame:
    return exact_percentiles(timings, value, {"p50": 0.5, "p95": 0.95}, by, bands)


def review_summary(review: DataFrame) -> DataFrame:
    """Totals of a review, the first image's time and the median of the others.

    ``review``: position, name_candidate_exact, name_in_normalized_text, counts of years and other
    phrases, elapsed_seconds.
    """
    sums = [
        "years_expected", "years_found", "years_unexpected", "other_expected", "other_found",
    ]
    timed = F.when(F.col("elapsed_seconds").isNotNull(), F.col("position"))
    totals = review.agg(
        F.count(F.lit(1)).alias("images"), F.count_if("name_candidate_exact").alias("name_candidate_exact"),
        F.count_if("name_in_normalized_text").alias("name_in_normalized_text"),
        *[F.sum(c).alias(c) for c in sums],
        F.min_by("elapsed_seconds", timed).alias("cold_seconds"), F.min(timed).alias("__cold"),
    )
    warm = review.where(F.col("position") > totals.select("__cold").scalar())
    median = exact_percentiles(warm, "elapsed_seconds", {"warm_median_seconds": 0.5})
    return totals.drop("__cold").withColumn("warm_median_seconds", median.select("warm_median_seconds").scalar())


def import_summary(catalog: DataFrame, source_id: str, expected: int | None = None) -> DataFrame:
    """Rows, distinct slugs and difference from the expected number of slugs."""
    rows = catalog.where(F.col("import_source") == source_id)
    out = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.coalesce(F.col("slug"), F.lit("")) != "").alias("unique_slugs"),
    )
    return out.select(F.lit(source_id).alias("source_id"), "rows", "unique_slugs", (
        F.col("unique_slugs") - F.lit(expected)).alias("difference"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def indexing_stats(outcomes: DataFrame) -> DataFrame:
    """One row of outcome counts with the run's status."""
    kinds = ("inserted", "updated", "skipped", "deleted", "error")
    counted = outcomes.agg(*[
        F.count_if(F.col("outcome") == k).alias("errors" if k == "error" else k) for k in kinds
    ])
    processed = F.col("inserted") + F.col("updated")
    return counted.withColumn("processed", processed).withColumn(
        "total", processed + F.col("skipped") + F.col("errors")
    ).withColumn("status", run_status(processed, F.col("errors")))


def text_confidence(blocks: DataFrame) -> DataFrame:
    """Letter-weighted confidence per image over blocks with at least three letters."""
    letters, conf = X.letter_count(F.col("normalized_text")), F.col("confidence")
    counts = letters >= 3
    usable = counts & N.is_finite(conf) & conf.between(0, 1)
    weight = F.when(usable, letters)
    return blocks.groupBy("image_id").agg(
        (F.sum(weight * conf) / F.sum(weight)).alias("text_confidence")
    )


def producer_vocabulary(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct (query, word) rows of the producer names among a query's candidates.

    Producer words are taken once per card, before the join.
    """
    words = cards.select("slug", F.explode(X.word_set(F.coalesce("winery", F.lit("")))).alias("word"))
    return candidates.select("query_id", "slug").distinct().join(words, "slug").select("query_id", "word").distinct()


def palette_histogram(pixels: DataFrame) -> DataFrame:
    """14 colour bins per image; NULL under 24 counted pixels.

    Pixels are counted per bin in one partial aggregate; a hue's share of its neighbours is taken
    from these counts.
    """
    hsv = N.rgb_to_hsv(F.col("red"), F.col("green"), F.col("blue"))
    p = pixels.where(F.col("alpha") >= 128).select("image_id", hsv.alias("c")).where("c.v >= 0.18")
    bin_no = F.when(F.col("c.s") < 0.16, F.when(F.col("c.v") > 0.7, 13).otherwise(12)).otherwise(
        F.least(F.lit(11), F.floor(F.col("c.h") * 12)).cast("int")
    )
    counts = p.select("image_id", bin_no.alias("b")).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(14)]
    )
    hue = lambda i: F.col(f"b{i}") * 0.6 + (F.col(f"b{(i - 1) % 12}") + F.col(f"b{(i + 1) % 12}")) * 0.2
    bins = [hue(i) / F.col("n") for i in range(12)] + [F.col(f"b{i}") / F.col("n") for i in (12, 13)]
    seen = pixels.select("image_id").distinct()
    return seen.join(counts, "image_id", "left").select(
        "image_id", F.when(F.col("n") >= 24, F.array(*bins)).alias("bins")
    )


def model_inventory(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (kind, model, dimension) of reference and text vectors."""
    image = refs.select(F.lit("image").alias("kind"), "model_name", F.size("embedding").alias("dimension"))
    text = catalog.where(F.col("description_text_embedding").isNotNull()).select(
        F.lit("text").alias("kind"), F.col("description_text_embedding_model").alias("model_name"),
        F.size("description_text_embedding").alias("dimension"),
    )
    return image.unionByName(text).distinct()


def gallery_fingerprint(gallery: DataFrame, scale: float = 1e8) -> DataFrame:
    """Item count, dimension and a digest of all ids and vectors.

    Row digests are added up in eight 32-bit parts, so the digest needs no order and no single task
    reads the gallery. Components are taken as integers after scaling.
    """
    ints = F.transform("embedding", lambda x: F.round(x.cast("double") * scale).cast("long").cast("string"))
    row = F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), F.array_join(ints, ",")), 256)
    parts = [
        F.sum(F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)
    ]
    sums = gallery.select(F.size("embedding").alias("__dim"), row.alias("__d")).agg(
        F.count(F.lit(1)).alias("item_count"), F.min("__dim").alias("dimension"),
        F.max("__dim").alias("max_dimension"), *parts,
    )
    digest = F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256)
    return sums.select("item_count", "dimension", "max_dimension", digest.alias("sha256"))
