"""User votes, the photo queue they fill, and the references they add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators.joins import unreferenced
from shelfmatch.operators.maintain import upsert_references
from shelfmatch.operators.windows import canonical_id
from shelfmatch.skew import banded_rank, first_per_key

FEEDBACK_SCHEMA = (
    "job_id string, image_sha256 string, predicted_slug string, is_correct boolean, correct_slug string, "
    "review_status string, embedding_state string, embedding_error string, reference_uri string, "
    "indexed_slug string, label_revision int, created_at timestamp, updated_at timestamp"
)
VOTE_COLUMNS = ["job_id", "image_sha256", "predicted_slug", "is_correct", "correct_slug", "seq", "ts"]


def label_accept(
    votes: DataFrame, predictions: DataFrame, catalog: DataFrame, card_url: str, feedback: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Votes with the label they stand for, and rejected votes with a reason.

    ``votes``: job_id, is_correct, correct_slug; ``predictions``: job_id, predicted_slug. A vote
    without a label is accepted only for a job that already has feedback.
    """
    named = votes.withColumn("__s", X.normalize_slug(F.col("correct_slug"), card_url))
    joined = named.join(predictions, "job_id", "left")
    if feedback is not None:
        joined = joined.join(feedback.select("job_id", F.lit(True).alias("__seen")), "job_id", "left")
    else:
        joined = joined.withColumn("__seen", F.lit(None).cast("boolean"))
    slug, predicted, correct = F.col("__s.slug"), F.col("predicted_slug"), F.col("is_correct")
    label = F.when(correct, predicted).otherwise(slug)
    known = catalog.select(F.col("slug").alias("__label")).distinct().withColumn("__known", F.lit(True))
    checked = joined.withColumn("__label", label).join(known, "__label", "left")
    reason = (
        F.when(predicted.isNull(), "unknown_job").when(~F.col("__s.valid"), "invalid_slug")
        .when(correct & slug.isNotNull() & (slug != predicted), "correct_vote_names_other_item")
        .when(~correct & (slug == predicted), "correction_equals_prediction")
        .when(~correct & slug.isNull() & F.col("__seen").isNull(), "label_missing")
        .when(F.col("__label").isNotNull() & F.col("__known").isNull(), "unknown_slug")
    )
    rest = [c for c in votes.columns if c != "correct_slug"]
    out = checked.withColumn("reason", reason).select(
        *rest, "predicted_slug", F.col("__label").alias("correct_slug"), "reason"
    )
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def upsert_feedback(feedback: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold votes into one row per job; returns the table and references that lost their label.

    Votes of a job apply in ``seq`` order. Each vote is compared with the one before it by joining
    consecutive ranks, so many votes for one job are not one task.
    """
    label, vote = ["correct_slug"], ["is_correct", "correct_slug"]
    ranked = banded_rank(votes.select(*VOTE_COLUMNS), ["job_id"], [F.col("seq")], F.floor(F.col("seq") / 4096), "__n")
    stored = feedback.select("job_id", *[F.col(c).alias(f"__p_{c}") for c in vote], F.lit(1).cast("long").alias("__n"))
    earlier = ranked.select("job_id", *[F.col(c).alias(f"__p_{c}") for c in vote], (F.col("__n") + 1).alias("__n"))
    before = earlier.unionByName(stored).withColumn("__has", F.lit(True))
    compared = ranked.join(before, ["job_id", "__n"], "left")
    differs = lambda cols: F.col("__has").isNotNull() & ~_all_equal(cols)
    per_job = compared.groupBy("job_id").agg(
        F.max_by(F.struct("is_correct", "correct_slug", "ts"), "seq").alias("last"),
        F.min_by(F.struct("image_sha256", "predicted_slug", "correct_slug", "ts"), "seq").alias("first"),
        F.count_if(differs(label)).alias("label_changes"), F.count_if(differs(vote)).alias("vote_changes"),
    )
    joined = feedback.withColumn("__c", F.lit(True)).alias("f").join(per_job.alias("v"), "job_id", "full")
    old, new = F.col("f.__c").isNotNull(), F.col("v.last").isNotNull()
    relabelled = new & (F.col("label_changes") > 0)
    state = (
        F.when(relabelled, "queued").when(~old & F.col("v.first.correct_slug").isNotNull(), "queued").when(~old, "unlabeled")
        .when(new & (F.col("f.embedding_state") == "failed"), "queued").otherwise(F.col("f.embedding_state"))
    )
    review = F.when(old & ~(new & (F.col("vote_changes") > 0)), F.col("f.review_status")).otherwise("pending")
    merged = joined.select(
        "job_id",
        F.coalesce("f.image_sha256", "v.first.image_sha256").alias("image_sha256"),
        F.coalesce("f.predicted_slug", "v.first.predicted_slug").alias("predicted_slug"),
        F.when(new, F.col("v.last.is_correct")).otherwise(F.col("f.is_correct")).alias("is_correct"),
        F.when(new, F.col("v.last.correct_slug")).otherwise(F.col("f.correct_slug")).alias("correct_slug"),
        review.alias("review_status"), state.alias("embedding_state"),
        F.when(~new, F.col("f.embedding_error")).alias("embedding_error"),
        F.when(~relabelled, F.col("f.reference_uri")).alias("reference_uri"),
        F.when(~relabelled, F.col("f.indexed_slug")).alias("indexed_slug"),
        (F.coalesce("f.label_revision", F.lit(0)) + F.coalesce("label_changes", F.lit(0))).cast("int").alias("label_revision"),
        F.coalesce("f.created_at", "v.first.ts").alias("created_at"),
        F.coalesce("v.last.ts", "f.updated_at").alias("updated_at"),
        F.when(relabelled, F.col("f.reference_uri")).alias("__retired"),
    )
    retired = merged.where("__retired is not null").select(F.col("__retired").alias("image_uri")).distinct()
    return merged.drop("__retired"), retired


def fold_votes(votes: DataFrame) -> DataFrame:
    """The feedback row that each job's votes make from nothing, and the last label they took back.

    The whole-table form of ``streaming.state.feedback_stream``: votes apply in ``seq`` order, a vote that
    is there more than once counts once, a new label queues the photo again.
    """
    once = votes.select(*VOTE_COLUMNS).dropDuplicates(["job_id", "seq"])
    ranked = banded_rank(once, ["job_id"], [F.col("seq")], F.floor(F.col("seq") / 4096), "__n")
    before = ranked.select("job_id", F.col("correct_slug").alias("__p"), (F.col("__n") + 1).alias("__n"), F.lit(True).alias("__has"))
    compared = ranked.join(before, ["job_id", "__n"], "left")
    changed = F.col("__has").isNotNull() & ~F.col("correct_slug").eqNullSafe(F.col("__p"))
    per_job = compared.groupBy("job_id").agg(
        F.min_by(F.struct("image_sha256", "predicted_slug", "correct_slug", "ts"), "seq").alias("first"),
        F.max_by(F.struct("is_correct", "correct_slug", "ts", "seq"), "seq").alias("last"), F.count_if(changed).alias("changes"),
        F.max_by("__p", F.when(changed & F.col("__p").isNotNull(), F.col("seq"))).alias("retired_label"),
    )
    queued = (F.col("changes") > 0) | F.col("first.correct_slug").isNotNull()
    return per_job.select(
        "job_id", "first.image_sha256", "first.predicted_slug", "last.is_correct", "last.correct_slug", F.lit("pending").alias("review_status"),
        F.when(queued, "queued").otherwise("unlabeled").alias("embedding_state"), F.col("changes").cast("int").alias("label_revision"),
        "retired_label", "last.seq", F.col("first.ts").alias("created_at"), F.col("last.ts").alias("updated_at"),
    )


def _all_equal(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return same


def retract_reference(refs: DataFrame, feedback: DataFrame, retired: DataFrame) -> DataFrame:
    """Remove retired feedback photos that no feedback row uses; catalog photos always stay."""
    gone = unreferenced(retired.where(F.col("image_uri").startswith(K.FEEDBACK_PREFIX)), feedback)
    return refs.join(gone, "image_uri", "left_anti").select(*refs.columns)


def take_queue(feedback: DataFrame) -> DataFrame:
    """Mark queued rows as being indexed."""
    queued = F.col("embedding_state") == "queued"
    return feedback.withColumns({
        "embedding_error": F.when(~queued, F.col("embedding_error")),
        "embedding_state": F.when(queued, "indexing").otherwise(F.col("embedding_state")),
    })


def recover_queue(feedback: DataFrame) -> DataFrame:
    """Queue unfinished rows, and labelled rows that were never indexed."""
    state = F.col("embedding_state")
    again = (state == "indexing") | ((state == "unlabeled") & F.col("correct_slug").isNotNull())
    return feedback.withColumn("embedding_state", F.when(again, "queued").otherwise(state))


def drop_stale_results(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Results computed for the label revision that a job still has."""
    current = feedback.select("job_id", F.col("label_revision").alias("revision"))
    return results.join(current, ["job_id", "revision"], "left_semi")


def dedupe_samples(samples: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per content hash; the stored or first one is kept."""
    fresh = incoming.join(samples.select("image_sha256"), "image_sha256", "left_anti")
    return samples.unionByName(first_per_key(fresh, ["image_sha256"], [F.col("created_at")]).select(*samples.columns))


def publish_feedback(
    feedback: DataFrame, refs: DataFrame, catalog: DataFrame, results: DataFrame, model: str, dim: int, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Publish embedded feedback photos; returns the feedback and reference tables.

    ``results``: job_id, revision, digest (of the prepared image), embedding, model_name, error.
    Results for an older label are ignored. A photo confirmed under two labels is published only
    under the label that is ready, or was queued first.
    """
    # ``drop_stale_results`` and the job's own columns in one join; feedback has one row per job.
    rows = results.join(
        feedback.select("job_id", "image_sha256", "correct_slug", "updated_at", "reference_uri", F.col("label_revision").alias("revision")),
        ["job_id", "revision"])
    canonical = canonical_id(catalog.select("id", "slug")).select(
        F.col("slug").alias("correct_slug"), F.col("canonical_id").cast("string").alias("item_id")
    ).distinct()
    rows = rows.join(canonical, "correct_slug", "left")
    labelled = F.col("correct_slug").isNotNull()
    broken = F.col("error").isNotNull() | (
        labelled & (F.col("item_id").isNull() | N.vector_problem(F.col("embedding"), F.col("model_name"), dim, model).isNotNull())
    )
    rows = rows.withColumn("__broken", F.coalesce(broken, F.lit(True)))
    # Where a label is ready, only that label passes ``against``; the label queued first leads only photos without one.
    ready = feedback.where("embedding_state = 'ready' and correct_slug is not null").select(
        "image_sha256", F.col("correct_slug").alias("__ready"))
    usable = rows.where(labelled & ~F.col("__broken")).select(
        "image_sha256", F.struct("updated_at", "job_id").alias("__at"), F.col("correct_slug").alias("__usable"))
    photos = ready.unionByName(usable, allowMissingColumns=True).groupBy("image_sha256").agg(
        F.min("__ready").alias("__low"), F.max("__ready").alias("__high"),
        F.min_by("__usable", F.when(F.col("__usable").isNotNull(), F.col("__at"))).alias("__first"),
    ).withColumn("__leader", F.when(F.col("__low").isNull(), F.col("__first"))).drop("__first")
    against = F.coalesce((F.col("__low") != F.col("correct_slug")) | (F.col("__high") != F.col("correct_slug")), F.lit(False))
    judged = rows.join(photos, "image_sha256", "left")
    fails = F.col("__broken") | (labelled & (against | (F.col("correct_slug") != F.coalesce("__leader", "correct_slug"))))
    uri = F.when(labelled, F.concat(F.lit(K.FEEDBACK_PREFIX), "item_id", F.lit("/"), "digest", F.lit(".png")))
    judged = judged.select(
        "job_id", fails.alias("__fails"), uri.alias("__uri"), F.col("correct_slug").alias("__slug"), "item_id",
        "model_name", "embedding", F.col("reference_uri").alias("__old"),
    )
    published = judged.where("not __fails and __uri is not null")
    incoming = first_per_key(published.select(
        "job_id", "item_id", F.col("__slug").alias("slug"), F.col("__uri").alias("image_uri"), "model_name", "embedding"
    ), ["image_uri"], [F.col("job_id")]).drop("job_id")
    table, _ = upsert_references(refs, incoming, now)
    joined = feedback.join(judged.select("job_id", "__fails", "__uri", "__slug", F.lit(True).alias("__done")), "job_id", "left")
    done = F.col("__done").isNotNull()
    ok, fail = done & ~F.col("__fails"), done & F.col("__fails") & (F.col("embedding_state") == "indexing")
    has_uri = F.col("__uri").isNotNull()
    pick = lambda name, value: F.when(ok, value).otherwise(F.col(name))
    updated = joined.select(
        *[c for c in feedback.columns if c not in (
            "embedding_state", "embedding_error", "indexed_slug", "reference_uri", "review_status")],
        F.when(ok & has_uri, "ready").when(ok, "unlabeled").when(fail, "failed").otherwise(F.col("embedding_state")).alias("embedding_state"),
        F.when(fail, K.INDEX_FAILURE).when(ok, F.lit(None)).otherwise(F.col("embedding_error")).alias("embedding_error"),
        pick("indexed_slug", F.col("__slug")).alias("indexed_slug"), pick("reference_uri", F.col("__uri")).alias("reference_uri"),
        F.when(ok & has_uri, "approved").when(ok, "pending").otherwise(F.col("review_status")).alias("review_status"),
    ).select(*feedback.columns)
    retired = judged.where(
        "not __fails and __old is not null and not (__old <=> __uri)"
    ).select(F.col("__old").alias("image_uri")).distinct()
    return updated, retract_reference(table, updated, retired)
