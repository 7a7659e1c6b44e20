"""Visual search, text search, geometric scores and retrieval evaluation for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import vectors as N
from shelfmatch.operators.aggregates import (
    evaluation_misses, evaluation_report, recall_at_k,
)
from shelfmatch.operators.joins import eval_queries_vs_index, references_by_item
from shelfmatch.operators.knn import BLOCK_BYTES, knn_distinct_items, knn_items
from shelfmatch.operators.ranking import rank_of_expected
from shelfmatch.session import cut_lineage
from shelfmatch.skew import banded_rank


def search_items(queries: DataFrame, refs: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest distinct items of every query: rank, distance, score and best photo."""
    found = knn_items(queries, refs, k, block_bytes=block_bytes)
    return found.select(
        "query_id", "rank", "item_id", "slug", F.col("image_uri").alias("best_image_uri"), "distance",
        (F.lit(1.0) - F.col("distance")).alias("score"),
    )


def match_text(queries: DataFrame, passages: DataFrame, k: int = K.BRANCH_LIMIT,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` closest catalog rows of distinct slugs with similarity in [0, 1]."""
    found = knn_distinct_items(queries, passages, k, block_bytes=block_bytes)
    return found.select(
        "query_id", "rank", "id", "slug", "distance", N.rescale_similarity(F.col("distance")).alias("score")
    )


def verify_candidates(pairs: DataFrame) -> DataFrame:
    """Geometric score per requested item, best first, then request order.

    ``pairs``: query_id, item_id, request_order, image_uri, matches, inliers. Inconsistent counts
    are dropped from scoring and show as ``invalid_pairs``. A list of any length is numbered in bands of
    its scores.
    """
    judged = pairs.withColumn("v", N.verify_decision(F.col("matches"), F.col("inliers")))
    scored = judged.groupBy("query_id", "item_id").agg(
        F.max(F.when(F.col("v.verified"), F.col("v.inlier_ratio")).otherwise(F.lit(0.0))).alias("score"),
        F.min("request_order").alias("request_order"), F.count_if(~F.col("v.valid")).alias("invalid_pairs"),
    )
    return banded_rank(scored, ["query_id"], [F.desc("score"), F.col("request_order")], F.floor((1 - F.col("score")) * 256))


def candidate_pairs(shortlist: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photo pairs to verify for each shortlisted item, and items without a photo."""
    asked = shortlist.select("query_id", "item_id", F.col("rank").alias("request_order"))
    return references_by_item(asked, refs)


def evaluate_retrieval(
    queries: DataFrame, refs: DataFrame, top_k: int, levels: tuple[int, ...] = K.RECALL_LEVELS,
    block_bytes: int = BLOCK_BYTES,
) -> dict[str, DataFrame]:
    """Recall, totals, misses and errors of labelled queries, searched in one join.

    ``queries``: query_id, model_name, embedding, expected.
    """
    ks = sorted({*levels, top_k})
    evaluable, errors = eval_queries_vs_index(queries, refs)
    # The ranking feeds four reports; it is computed once and survives the loss of an executor.
    ranked = cut_lineage(search_items(evaluable, refs, ks[-1], block_bytes))
    ranks = rank_of_expected(ranked, evaluable)
    return {
        "ranks": ranks, "ranked": ranked, "recall": recall_at_k(ranks, ks),
        "report": evaluation_report(ranks, errors, top_k),
        "misses": evaluation_misses(ranks, ranked, top_k), "errors": errors,
    }


def recall_report(queries: DataFrame, refs: DataFrame, top_k: int,
                  levels: tuple[int, ...] = K.RECALL_LEVELS) -> DataFrame:
    """Only the recall table: one pass, nothing kept."""
    ks = sorted({*levels, top_k})
    evaluable, _ = eval_queries_vs_index(queries, refs)
    return recall_at_k(rank_of_expected(search_items(evaluable, refs, ks[-1]), evaluable), ks)


__all__ = [
    "search_items", "match_text", "verify_candidates", "candidate_pairs", "evaluate_retrieval",
    "recall_report",
]
