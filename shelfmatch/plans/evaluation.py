"""Quality reports over saved predictions: image variants and manual reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch.functions import text as X
from shelfmatch.operators.aggregates import (
    degradation_report, latency_percentiles, mean_rank_recall, ocr_quality, quality_by_condition, review_summary,
    variant_status,
)
from shelfmatch.operators.sets import missing_and_unexpected
from shelfmatch.operators.validate import split_leakage
from shelfmatch.operators.windows import adjacent_fragments

OCR_METRICS = {"cer": True, "exact_name": False, "exact_producer": False, "exact_year": False, "exact_all": False}
RECALL_METRICS = {"recall_at_1": False, "recall_at_5": False}


def ocr_metrics(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Error rate and exact fields per (sample, variant) that has truth and a prediction.

    ``samples``: sample_id, conditions, truth; ``predictions``: sample_id, variant, prediction.
    """
    known = samples.where("truth is not null").select("sample_id", "conditions", "truth")
    joined = predictions.where("prediction is not null").select("sample_id", "variant", "prediction").join(known, "sample_id")
    side = lambda s: {f: F.coalesce(F.col(f"{s}.{f}"), F.lit("")) for f in ("name", "producer", "year")}
    return joined.select(
        "sample_id", "variant", "conditions",
        X.character_error_rate(
            F.coalesce("truth.full_text", F.lit("")), F.coalesce("prediction.full_text", F.lit(""))).alias("cer"),
        X.exact_fields(side("truth"), side("prediction")).alias("e"),
    ).select("sample_id", "variant", "conditions", "cer", *[
        F.col(f"e.{f}").alias(f"exact_{f}") for f in ("name", "producer", "year", "all")])


def evaluate_variants(
    samples: DataFrame, predictions: DataFrame, ranks: DataFrame, statuses: DataFrame, timings: DataFrame
) -> dict[str, DataFrame]:
    """Report tables of a variant comparison.

    ``ranks``: sample_id, variant, conditions, rank; ``statuses``: sample_id, variant, status;
    ``timings``: sample_id, ms.
    """
    ocr = ocr_metrics(samples, predictions)
    recall = ranks.withColumns({
        "recall_at_1": (F.col("rank") <= 1).cast("int"), "recall_at_5": (F.col("rank") <= 5).cast("int")
    })
    return {
        "problems": split_leakage(samples), "variants": variant_status(statuses), "ocr": ocr_quality(ocr),
        "retrieval": mean_rank_recall(ranks),
        "degradation": degradation_report(ocr, OCR_METRICS).unionByName(degradation_report(recall, RECALL_METRICS)),
        "by_condition": quality_by_condition(ocr, ranks),
        "timing": latency_percentiles(timings), "timing_by_sample": latency_percentiles(timings, ["sample_id"]),
    }


def review_images(review: DataFrame) -> DataFrame:
    """Matches of every review image against its truth.

    ``review``: image_id, position, elapsed_seconds, name, years, other (truth), candidate_name,
    normalized_text, observed_years.
    """
    text = F.col("normalized_text")
    years = missing_and_unexpected(F.array_distinct("years"), F.array_distinct("observed_years"))
    other = F.transform("other", lambda p: F.struct(p.alias("text"), X.contains_phrase(
        text, _folded(p), normalized=True).alias("found")))
    exact = F.coalesce(X.normalize_text(F.col("candidate_name")) == X.normalize_text(F.col("name")), F.lit(False))
    out = review.select(
        "image_id", "position", "elapsed_seconds", "name", "candidate_name",
        exact.alias("name_candidate_exact"),
        X.contains_phrase(text, F.col("name")).alias("name_in_normalized_text"), years.alias("y"),
        F.size("years").alias("years_expected"), other.alias("o"),
    )
    return out.select(
        "image_id", "position", "elapsed_seconds", "name", "candidate_name", "name_candidate_exact",
        "name_in_normalized_text", F.col("y.found").alias("found_years"), F.col("y.missing").alias("missing_years"),
        F.col("y.unexpected").alias("unexpected_years"), "years_expected", F.size("y.found").alias("years_found"),
        F.size("y.unexpected").alias("years_unexpected"), F.size("o").alias("other_expected"),
        F.size(F.filter("o", lambda e: e["found"])).alias("other_found"), F.col("o").alias("other"),
    )


def _folded(c):
    """Normalization of a lambda value, where Python functions cannot run."""
    return X.collapse_space(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def evaluate_review(review: DataFrame) -> tuple[DataFrame, DataFrame]:
    images = review_images(review)
    return images, review_summary(images)
