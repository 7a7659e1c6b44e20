import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmatch.operators import feedback as O
from shelfmatch.operators import windows as W
from shelfmatch.sources import tables
from shelfmatch.sources.buckets import bucket_of, create_buckets, read_buckets, replace_buckets
from shelfmatch.streaming import jobs as S
from shelfmatch.streaming import state as K
from tests.test_maintain import state, votes

ROWS = [("a", True, "p", 1), ("b", False, None, 2), ("a", True, "p", 3), ("b", False, "x", 4), ("b", False, "y", 5), ("a", False, "z", 6)]


def drain(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each state partition starts workers of its own; small streams need one."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run_over(spark, folder, schema, work, mode, check, seen):
    """One start of a stream over files, which ends when no file is left.

    Timers of the clock ask for one more batch again and again, so a stream with them runs one.
    """
    ends = {"once": True} if mode == "append" else {"availableNow": True}
    stream = work(spark.readStream.schema(schema).parquet(folder))
    drain(stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: seen.extend(df.collect())).option(
        "checkpointLocation", check).trigger(**ends).start())


def test_vote_stream_agrees_with_batch_after_restarts_shuffles_and_replays(spark, tmp_path):
    source, seen = str(tmp_path / "votes"), []
    draw = random.Random(3)
    rows = [(f"j{draw.randrange(4)}", draw.random() < 0.5, draw.choice(["p", "q", None]), n) for n in range(1, 61)]
    parts = [rows[at : at + 20] for at in (0, 20, 40)]
    for part in parts:
        # Each start reads files in which votes are out of order, repeated, or came before.
        mixed = part + draw.choices(rows[: part[-1][3]], k=15)
        draw.shuffle(mixed)
        votes(spark, mixed).coalesce(1).write.mode("append").parquet(source)
        run_over(spark, source, votes(spark, ROWS[:1]).schema, K.feedback_stream, "update", str(tmp_path / "check"), seen)
    last = {r.job_id: r for r in seen}
    batch = {r.job_id: r for r in O.fold_votes(votes(spark, rows)).collect()}
    assert {k: v.asDict() for k, v in last.items()} == {k: v.asDict() for k, v in batch.items()}
    stored, _ = O.upsert_feedback(spark.createDataFrame([], O.FEEDBACK_SCHEMA), votes(spark, rows))
    assert state(stored) == {k: (r.is_correct, r.correct_slug, r.review_status, r.embedding_state, r.label_revision) for k, r in last.items()}


def test_settled_votes_leave_the_waiting_list(spark, tmp_path):
    """With no lateness only the newest votes wait; late ones that were folded change nothing."""
    source, seen = str(tmp_path / "votes"), []
    for part in (ROWS[:2], ROWS[2:4], ROWS[:1] + ROWS[4:]):
        votes(spark, part).coalesce(1).write.mode("append").parquet(source)
        run_over(spark, source, votes(spark, ROWS[:1]).schema, lambda df: K.feedback_stream(df, "0 seconds"), "update", str(tmp_path / "check"), seen)
    last = {r.job_id: (r.is_correct, r.correct_slug, r.label_revision, r.seq) for r in seen}
    want = {r.job_id: (r.is_correct, r.correct_slug, r.label_revision, r.seq) for r in O.fold_votes(votes(spark, ROWS)).collect()}
    assert last == want
    state_rows = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "check"))
    assert state_rows.count() <= 2


EVENTS = "job_id string, seq long, t long, stage string, progress double"


def job_events(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_job_stream_agrees_with_batch_after_a_restart(spark, tmp_path):
    draw = random.Random(5)
    stages = ["queued", "prepare", "search", "rerank", "done", "failed"]
    rows = [(f"j{draw.randrange(5)}", n, n // 2, draw.choices(stages, [1, 9, 9, 9, 1, 1])[0], draw.random()) for n in range(120)]
    source, seen = str(tmp_path / "events"), []
    for at in (0, 40, 80):
        part = rows[at : at + 40]
        draw.shuffle(part)
        job_events(spark, part + part[:5]).coalesce(1).write.mode("append").parquet(source)
        run_over(spark, source, job_events(spark, rows[:1]).schema, K.job_state_stream, "append", str(tmp_path / "check"), seen)
    want = W.job_states(job_events(spark, rows)).collect()
    assert sorted((r.asDict() for r in seen), key=str) == sorted((r.asDict() for r in want), key=str)


def test_finished_jobs_expire_by_the_clock(spark, tmp_path):
    source, seen = str(tmp_path / "events"), []
    job_events(spark, [("a", 1, 0, "prepare", 0.1), ("a", 2, 2, "done", 1.0), ("b", 3, 1, "search", 0.4)]).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for again in (False, True):
        if again:
            time.sleep(2)
            job_events(spark, [("b", 4, 9, "rerank", 0.6)]).coalesce(1).write.mode("append").parquet(source)
        run_over(spark, source, schema, lambda df: K.job_state_stream(df, 1), "append", str(tmp_path / "check"), seen)
    assert [(r.state, r.progress) for r in seen if r.job_id == "a"] == [("processing", 0.1), ("done", 1.0), ("expired", 1.0)]
    assert [r.state for r in seen if r.job_id == "b"] == ["processing", "processing"]


class Clock:
    """State and clock of one key, as the state store gives them."""

    def __init__(self):
        self.values, self.now, self.timers = {}, 0, []

    def getValueState(self, name, schema, ttl=None):
        return Cell(self, name, ttl)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Cell:
    def __init__(self, clock, name, ttl):
        self.clock, self.name, self.ttl = clock, name, ttl

    def exists(self):
        found = self.clock.values.get(self.name)
        return found is not None and (self.ttl is None or self.clock.now < found[1] + self.ttl)

    def get(self):
        return self.clock.values[self.name][0]

    def update(self, value):
        self.clock.values[self.name] = value, self.clock.now

    def clear(self):
        self.clock.values.pop(self.name, None)


def test_a_mark_stays_behind_an_expired_job():
    clock, job = Clock(), K.JobStates(1000)
    job.init(clock)

    def events(*rows):
        frame = pd.DataFrame(rows, columns=["seq", "ts", "stage", "progress"]).assign(ts=lambda d: pd.to_datetime(d.ts, unit="s"))
        return [r for part in job.handleInputRows(("a",), iter([frame]), clock) for r in part.to_dict("records")]

    rows = [(1, 5, "prepare", 0.3), (2, 6, "done", 0.2), (3, 7, "search", 0.1)]
    assert [(r["state"], r["progress"], r["elapsed_ms"]) for r in events(*rows)] == [("processing", 0.3, 0), ("done", 0.3, 1000), ("done", 0.3, 2000)]
    assert clock.timers == [1000] and events(*rows) == []
    clock.now = 1500
    assert [r["state"] for part in job.handleExpiredTimer(("a",), clock, None) for r in part.to_dict("records")] == ["expired"]
    assert events(*rows) == []  # replayed inside the time to live of the mark
    clock.now = 2600
    assert len(events(*rows)) == 3  # forgotten altogether


def test_sample_dedupe(spark, tmp_path):
    photos = spark.createDataFrame([("h1", 1), ("h2", 2), ("h1", 3)], "image_sha256 string, n int")
    photos.coalesce(1).write.parquet(str(tmp_path / "photos"))
    kept = []
    unique = S.sample_dedupe_stream(spark.readStream.schema(photos.schema).parquet(str(tmp_path / "photos")))
    drain(unique.writeStream.foreachBatch(lambda d, _: kept.extend(d.collect())).option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start())
    assert sorted(r["image_sha256"] for r in kept) == ["h1", "h2"]


def test_index_feedback_stream_rewrites_only_touched_buckets(spark, tmp_path):
    """Ten queued votes in passes of three: one model call a row, and other buckets keep their files."""
    store = S.FeedbackTables(str(tmp_path / "tables"), 16)
    rows = [(f"j{n}", False, "nope" if n == 4 else "x", n + 1) for n in range(10)]
    queued, _ = O.upsert_feedback(spark.createDataFrame([], O.FEEDBACK_SCHEMA), votes(spark, rows))
    idle = queued.limit(0).unionByName(votes(spark, [(f"old{n}", True, "p", 1) for n in range(40)]).select(
        "job_id", "image_sha256", "predicted_slug", "is_correct", "correct_slug", F.lit("approved").alias("review_status"), F.lit("ready").alias("embedding_state"),
        F.lit(None).cast("string").alias("embedding_error"), F.concat(F.lit("/data/reference/feedback/1/"), "job_id").alias("reference_uri"),
        F.col("correct_slug").alias("indexed_slug"), F.lit(0).alias("label_revision"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")))
    old = idle.select(
        F.expr("row_number() over (order by job_id)").cast("long").alias("id"), F.lit("1").alias("item_id"), F.lit("p").alias("slug"), F.col("reference_uri").alias("image_uri"),
        F.lit("m").alias("model_name"), F.array(F.lit(2.0)).cast("array<float>").alias("embedding"), "created_at", "updated_at")
    store.create(queued.unionByName(idle).coalesce(1), old.coalesce(1))
    catalog = spark.createDataFrame([(3, "x"), (1, "p")], "id long, slug string")
    calls = tmp_path / "calls"

    def noted(batches):
        for batch in batches:
            with calls.open("a") as log:
                log.write("x" * len(batch))
            yield batch

    embed = lambda q: q.mapInPandas(noted, q.schema).select(
        "job_id", "label_revision", F.md5("image_sha256").alias("digest"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"),
        F.lit("m").alias("model_name"), F.lit(None).cast("string").alias("error"))
    files = lambda name: {str(f) for f in (tmp_path / "tables" / name).rglob("*.parquet")}
    before = {name: files(name) for name in ("feedback", "references")}
    wake = str(tmp_path / "wake")
    spark.createDataFrame([("j0",)], "job_id string").write.parquet(wake)
    drain(S.index_feedback_stream(
        spark.readStream.schema("job_id string").parquet(wake), store, lambda _: catalog, str(tmp_path / "check"), embed, "m", 1, rows=4, every=None))
    assert calls.read_text() == "x" * 10
    got = {r.job_id: r.embedding_state for r in store.feedback(spark).collect()}
    assert got == {f"j{n}": "failed" if n == 4 else "ready" for n in range(10)} | {f"old{n}": "ready" for n in range(40)}
    added = store.references(spark).where("slug = 'x'")
    assert added.count() == 9 and {r.item_id for r in added.collect()} == {"3"} and store.references(spark).count() == 49
    hit = {r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "k string").select(bucket_of("k", 16)).collect()}
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in before["feedback"] ^ files("feedback")}
    assert changed == hit and before["feedback"] & files("feedback")
    assert before["references"] & files("references")


def test_emptied_buckets_lose_their_folder(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(20).select("id", F.col("id").cast("string").alias("k"))
    create_buckets(df, root, "t", "k", 4)
    gone = df.where(bucket_of("k", 4) != 2)
    replace_buckets(gone, spark.createDataFrame([(2,)], "bucket int"), root, "t", "k", 4)
    assert {r.id for r in read_buckets(spark, root, "t", "id long, k string").collect()} == {r.id for r in gone.collect()}
    assert not list(tmp_path.glob("t/bucket=2"))


def test_versions_are_claimed_by_one_writer(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.write_table(spark.range(3), root, "n") == 1
    assert tables._claimed(spark, root, "n", 2) and not tables._claimed(spark, root, "n", 2)
    assert tables.write_table(spark.range(4), root, "n") == 3 and tables.read_table(spark, root, "n").count() == 4


def test_incremental_catalog_sees_files_once(spark, tmp_path):
    path, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), []
    for n in range(2):
        spark.range(n * 10, n * 10 + 3).coalesce(1).write.mode("append").parquet(path)
        drain(S.incremental_catalog(spark, path, "id long", check, lambda b: seen.append(sorted(r["id"] for r in b.collect()))))
    assert seen == [[0, 1, 2], [10, 11, 12]]
