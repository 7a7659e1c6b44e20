"""Canonical rows, first occurrences and running values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.skew import banded_previous, banded_rank, first_per_key, range_rank


def canonical_id(df: DataFrame, key: str = "slug", id_col: str = "id") -> DataFrame:
    """Adds ``canonical_id``, the smallest id of the slug: a pre-aggregated minimum joined back."""
    smallest = df.groupBy(key).agg(F.min(id_col).alias("canonical_id"))
    return df.join(smallest, key)


def one_card_per_slug(catalog: DataFrame) -> DataFrame:
    """One row per slug: a row with a web photo first, then the lowest id."""
    order = [F.when(F.col("web_photo").isNotNull(), 0).otherwise(1), F.col("id")]
    return first_per_key(catalog, ["slug"], order)


def canonical_reference(refs: DataFrame) -> DataFrame:
    """One reference per (model, slug): a web reference first, then the lowest id."""
    order = [F.when(F.col("image_uri").contains(K.WEB_REFERENCE_MARK), 0).otherwise(1), F.col("id")]
    return first_per_key(refs, ["model_name", "slug"], order)


def first_occurrence(refs: DataFrame, path: str = "path", position: str = "position") -> tuple[DataFrame, DataFrame]:
    """The first row of every resolved path, and the later rows that are skipped."""
    first = refs.groupBy(path).agg(F.min(position).alias("__first"))
    marked = refs.join(first, path)
    kept = marked.where(F.col(position) == F.col("__first")).select(*refs.columns)
    return kept, marked.where(F.col(position) > F.col("__first")).select(*refs.columns)


def stage_progress(events: DataFrame, segment: str = "hour") -> DataFrame:
    """Progress that never falls, time since the job began and time since the previous stage.

    ``events``: job_id, seq (unique, in order), ts, stage, progress. A job is cut into time
    segments, so one job with very many events is spread over tasks.
    """
    seconds = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier)
    out = banded_previous(
        events, ["job_id"], [F.col("ts"), F.col("seq")], F.date_trunc(segment, "ts"),
        running_max={"__progress": "progress"}, previous={"__before": "ts"}, first={"__created": "ts"},
    )
    return out.select(
        "job_id", "seq", "stage", F.col("__progress").alias("progress"),
        F.round(seconds(F.col("ts"), F.col("__created")) / 1000).cast("long").alias("elapsed_ms"),
        F.round(seconds(F.col("ts"), F.col("__before")) / 1000).cast("long").alias("stage_ms"),
    )


def job_states(events: DataFrame, segment: str = "hour") -> DataFrame:
    """State, progress and time since the beginning after every event of every job.

    The whole-table form of ``streaming.state.job_state_stream``. ``events``: job_id, seq, ts, stage,
    progress, taken by (ts, seq). The first event that finishes a job settles its state; it is found by
    an aggregate, and running values by time segments, so one job with very many events is no task.
    """
    order = F.struct("ts", "seq")
    ends = events.where(F.col("stage").isin("done", "failed")).groupBy("job_id").agg(
        F.min_by("stage", order).alias("__end"), F.min(order).alias("__at"))
    running = banded_previous(
        events, ["job_id"], [F.col("ts"), F.col("seq")], F.date_trunc(segment, "ts"),
        running_max={"__progress": "progress"}, previous={}, first={"__created": "ts"},
    )
    state = F.when(order >= F.col("__at"), F.col("__end")).when(F.col("stage") == "queued", "queued").otherwise("processing")
    elapsed = (F.unix_micros("ts") - F.unix_micros("__created")) / 1000
    return running.join(ends, "job_id", "left").select(
        "job_id", "seq", state.alias("state"), "stage", F.greatest("__progress", F.lit(0.0)).alias("progress"),
        F.floor(elapsed + 0.5).cast("long").alias("elapsed_ms"), F.col("ts").alias("updated_at"),
    )


def retain_jobs(jobs: DataFrame, now, retention_s: int = K.JOB_RETENTION_SECONDS,
                capacity: int = K.JOB_CAPACITY) -> DataFrame:
    """Jobs kept in memory when the next one is admitted.

    Completed jobs beyond the retention go; then the oldest completed ones until fewer than
    ``capacity`` jobs remain. Unfinished jobs always stay.
    """
    done = F.col("completed_at")
    alive = jobs.where(done.isNull() | (F.lit(now).cast("timestamp") - done <= F.make_dt_interval(secs=F.lit(retention_s))))
    ranked = range_rank(alive.where(done.isNotNull()), [done, F.col("job_id")], "__oldest")
    excess = alive.agg((F.count(F.lit(1)) - (capacity - 1)).alias("__excess"))
    kept = ranked.where(F.col("__oldest") > excess.scalar()).select(*jobs.columns)
    return kept.unionByName(alive.where(done.isNull()))


def adjacent_fragments(blocks: DataFrame, segment: int = 64) -> DataFrame:
    """Each block, and each block with the next one of its variant.

    ``blocks``: image_id, variant, pos, text, confidence, where ``pos`` counts the blocks of one
    image. Neighbours are found by joining consecutive ranks, so no image is one task.
    """
    ranked = banded_rank(
        blocks, ["image_id", "variant"], [F.col("pos")], F.floor(F.col("pos") / segment), "__n"
    ).select("image_id", "variant", "pos", "text", "confidence", "__n")
    following = ranked.select(
        "image_id", "variant", (F.col("__n") - 1).alias("__n"), F.col("pos").alias("__pos"),
        F.col("text").alias("__text"), F.col("confidence").alias("__conf"),
    )
    pairs = ranked.join(following, ["image_id", "variant", "__n"]).select(
        "image_id", "variant", F.concat_ws(" ", "text", "__text").alias("text"),
        F.array("pos", "__pos").alias("positions"), F.least("confidence", "__conf").alias("confidence"),
    )
    singles = ranked.select("image_id", "variant", "text", F.array("pos").alias("positions"), "confidence")
    return singles.unionByName(pairs)


def latest_per_key(df: DataFrame, keys: list[str], order: str, unique: str) -> DataFrame:
    """The newest row per key, by a pre-aggregated maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col(unique)))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)
