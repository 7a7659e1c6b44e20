"""Continuous feedback, job states and incremental catalog work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.operators.feedback import FEEDBACK_SCHEMA, publish_feedback, recover_queue
from shelfmatch.session import cut_lineage
from shelfmatch.sources.buckets import bucket_of, create_buckets, read_buckets, replace_buckets

def sample_dedupe_stream(samples: DataFrame) -> DataFrame:
    """Every photo once. The state keeps all digests, as the sample table does."""
    return samples.dropDuplicates(["image_sha256"])


REFERENCES = (
    "id bigint, item_id string, slug string, image_uri string, model_name string, embedding array<float>, "
    "created_at timestamp, updated_at timestamp"
)


@dataclass(frozen=True)
class FeedbackTables:
    """Feedback rows by job and references by image, each in hash buckets below ``root``; the catalog is only read."""

    root: str
    buckets: int = 64

    def create(self, feedback: DataFrame, refs: DataFrame) -> None:
        create_buckets(feedback, self.root, "feedback", "job_id", self.buckets)
        create_buckets(refs, self.root, "references", "image_uri", self.buckets)

    def feedback(self, spark: SparkSession) -> DataFrame:
        return read_buckets(spark, self.root, "feedback", FEEDBACK_SCHEMA)

    def references(self, spark: SparkSession) -> DataFrame:
        return read_buckets(spark, self.root, "references", REFERENCES)


def index_next(
    spark: SparkSession, tables: FeedbackTables, catalog: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, dim: int,
    rows: int = 10_000,
) -> int:
    """Embed and publish the ``rows`` oldest queued votes; how many there were.

    ``embed`` turns (job_id, image_sha256, label_revision) into (digest, embedding, model_name, error) and
    sees every row once. Only buckets with a row that changes are written: first references, then
    feedback, so a job that dies in between finds its rows queued again.
    """
    feedback = tables.feedback(spark)
    current = recover_queue(feedback)
    queue = current.where("embedding_state = 'queued'").orderBy("updated_at", "job_id").limit(rows)
    taken = cut_lineage(queue.select("job_id", "image_sha256", "label_revision", "bucket"))
    count = taken.count()
    if not count:
        return 0
    results = cut_lineage(embed(taken.drop("bucket")).withColumnRenamed("label_revision", "revision"))
    mine = taken.select("job_id", F.lit(True).alias("__mine"))
    marked = current.join(mine, "job_id", "left").withColumn(
        "embedding_state", F.when(F.col("__mine"), "indexing").otherwise(F.col("embedding_state"))).select(*feedback.columns)
    refs = tables.references(spark)
    updated, table = publish_feedback(marked.drop("bucket"), refs.drop("bucket"), catalog, results, model, dim, F.current_timestamp())
    # Images that appear, change or go: those of the taken jobs, before and after.
    updated = cut_lineage(updated)
    images = feedback.join(mine, "job_id").select("reference_uri").union(updated.join(mine, "job_id").select("reference_uri"))
    touched = images.where("reference_uri is not null").select(bucket_of("reference_uri", tables.buckets).alias("bucket")).distinct()
    replace_buckets(table, cut_lineage(touched), tables.root, "references", "image_uri", tables.buckets)
    replace_buckets(updated, taken, tables.root, "feedback", "job_id", tables.buckets)
    return count


def drain_queue(
    spark: SparkSession, tables: FeedbackTables, catalog: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, dim: int,
    rows: int = 10_000,
) -> int:
    """Passes over the queue until it is empty; votes that are queued meanwhile are taken too."""
    done = 0
    while count := index_next(spark, tables, catalog, embed, model, dim, rows):
        done += count
    return done


def index_feedback_stream(
    wakes: DataFrame, tables: FeedbackTables, catalog: Callable[[SparkSession], DataFrame], checkpoint: str,
    embed: Callable[[DataFrame], DataFrame], model: str, dim: int, rows: int = 10_000, every: str | None = "30 seconds",
):
    """Drain the queue at every wake-up (rows of job_id) and, as a stream of its own clock, every ``every``.

    With ``every`` None the stream ends when no wake-up is left.
    """
    spark = wakes.sparkSession
    if every:
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(None).cast("string").alias("job_id"))
        wakes = wakes.select("job_id").union(clock)

    def drain(batch: DataFrame, _: int) -> None:
        drain_queue(batch.sparkSession, tables, catalog(batch.sparkSession), embed, model, dim, rows)

    ends = {"processingTime": every} if every else {"availableNow": True}
    return wakes.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(**ends).start()


def incremental_catalog(
    spark: SparkSession, path: str, schema: str, checkpoint: str, work: Callable[[DataFrame], None], files_per_batch: int = 64
):
    """Run ``work`` on catalog files that no earlier run has seen, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.foreachBatch(lambda batch, _: work(batch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
