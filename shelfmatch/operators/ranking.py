"""Best rows, top-k, ranks and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.skew import banded_rank, first_per_key, rank_bounded, top_per_key


def best_per_item(matches: DataFrame, query_id: str = "query_id", item: str = "item_id",
                  tie: str = "image_uri") -> DataFrame:
    """The closest photo of every item per query."""
    return first_per_key(matches, [query_id, item], [F.col("distance"), F.col(tie)])


def top_items(best: DataFrame, k: int, query_id: str = "query_id", item: str = "item_id") -> DataFrame:
    """The ``k`` closest items per query with similarity ``score``."""
    ranked = top_per_key(best, [query_id], [F.col("distance"), F.col(item)], k)
    return ranked.withColumn("score", F.lit(1.0) - F.col("distance"))


def distinct_top_k(matches: DataFrame, k: int, **names: str) -> DataFrame:
    """Top items of a match list: grouped first, so no over-fetching is needed."""
    item = {n: v for n, v in names.items() if n in ("query_id", "item")}
    return top_items(best_per_item(matches, **names), k, **item)


def best_pair_per_item(pairs: DataFrame) -> DataFrame:
    """Best inlier ratio among the verified photos of an item, else 0."""
    score = F.max(F.when(F.col("verified"), F.col("inlier_ratio")).otherwise(F.lit(0.0)))
    return pairs.groupBy("query_id", "item_id").agg(score.alias("score"))


def top_scores(scores: DataFrame, n: int = K.BRANCH_LIMIT, key: str = "item_id",
               order: str | None = None) -> DataFrame:
    """Best score per id, cut to ``n`` per query.

    Equal scores keep the order in which ids first arrived (``order``), or id order without it.
    """
    arrival = F.min(order) if order else F.min(key)
    best = scores.groupBy("query_id", key).agg(
        F.max("score").alias("score"), arrival.alias("__arrival")
    )
    return top_per_key(best, ["query_id"], [F.desc("score"), F.col("__arrival"), F.col(key)], n).drop("__arrival")


def rank_of_expected(ranked: DataFrame, truth: DataFrame, item: str = "item_id") -> DataFrame:
    """Rank of the true item per query, NULL when it is not in the ranking."""
    hit = ranked.select("query_id", F.col(item).alias("expected"), "rank")
    return truth.select("query_id", "expected").join(hit, ["query_id", "expected"], "left")


def score_margin(ranked: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Top score minus the next score per query; ``allowed`` restricts who can be the next one."""
    other = F.col("rank") > 1
    if allowed is not None:
        other = other & allowed
    return ranked.groupBy("query_id").agg(
        F.min_by(F.when(F.col("rank") == 1, F.col("score")), "rank").alias("top_score"),
        F.min_by(F.when(other, F.col("score")), F.when(other, F.col("rank"))).alias("next_score"),
    ).withColumn("margin", F.col("top_score") - F.col("next_score"))


def stable_ties(scores: DataFrame, order: str = "src_order") -> DataFrame:
    """Rank by score; equal scores keep the shortlist order."""
    return rank_bounded(scores, ["query_id"], [F.desc("score"), F.col(order)])


def top_ids(ranked: DataFrame, n: int | None = K.SHORTLIST_LIMIT, item: str = "item_id") -> DataFrame:
    """Ids of the best ``n`` items, or of all, in order."""
    top = ranked if n is None else ranked.where(F.col("rank") <= n)
    ids = F.sort_array(F.collect_list(F.struct("rank", item)))
    return top.groupBy("query_id").agg(ids.alias("r")).select(
        "query_id", F.transform("r", lambda e: e[item]).alias("ids")
    )


def page_items(refs: DataFrame, model: str, limit: int, offset: int) -> DataFrame:
    """One page of indexed items in id order."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    items = refs.where(F.col("model_name") == model).groupBy("item_id").agg(
        F.min("slug").alias("slug"), F.count(F.lit(1)).alias("photos")
    )
    return items.orderBy("item_id").offset(offset).limit(limit)


def reading_order(blocks: DataFrame, band_height: float = 64.0) -> DataFrame:
    """Position from top to bottom, left to right, then text; blocks without a box come last.

    Bands of the page height, and of the first letters for blocks without a box, keep an image of any
    number of blocks out of a single task. ``seq`` is the order in which the engine returned the blocks.
    """
    top, left = F.col("box.min_y"), F.col("box.min_x")
    letters = F.conv(F.rpad(F.hex(F.substring(F.encode("normalized_text", "utf-8"), 1, 3)), 6, "0"), 16, 10).cast("long")
    band = F.coalesce(F.floor(top / band_height), F.lit(2**62) + F.coalesce(letters, F.lit(-1))).cast("long")
    order = [top.asc_nulls_last(), left.asc_nulls_last(), F.col("normalized_text"), F.col("seq")]
    return banded_rank(blocks, ["image_id"], order, band, "pos")


def reading_key() -> Column:
    """A value that sorts the blocks of an image as ``reading_order`` numbers them."""
    top, left = F.col("box.min_y"), F.col("box.min_x")
    return F.struct(top.isNull().alias("no_top"), top.alias("top"), left.isNull().alias("no_left"), left.alias("left"), "normalized_text", "seq")


def queue_order(feedback: DataFrame) -> DataFrame:
    """Queued feedback, oldest first."""
    return feedback.where(F.col("embedding_state") == "queued").orderBy("updated_at", "job_id")


def vintage_rerank(ranked: DataFrame, year: str = "detected_year", vintage: str = "vintage") -> DataFrame:
    """Equal year first, unknown next, others last; the old order inside each class."""
    again = rank_bounded(ranked, ["query_id"], [vintage_class(year, vintage), F.col("rank")], "__rank")
    return again.withColumn("rank", F.col("__rank")).drop("__rank")


def vintage_class(year: str = "detected_year", vintage: str = "vintage") -> Column:
    """0: the detected year or none detected, 1: unknown vintage, 2: another one."""
    return F.when(F.col(year).isNull() | F.col(vintage).eqNullSafe(F.col(year)), 0).when(
        F.col(vintage).isNull(), 1
    ).otherwise(2)


def single_exact_reference(ranked: DataFrame, exact: Column) -> DataFrame:
    """Mark the one qualifying candidate of a query; none when several qualify."""
    counts = Window.partitionBy("query_id")
    flagged = ranked.withColumn("__exact", F.coalesce(exact, F.lit(False)))
    return flagged.withColumn(
        "promoted", F.col("__exact") & (F.count_if("__exact").over(counts) == 1)
    ).drop("__exact")
