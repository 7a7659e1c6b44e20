"""Votes, photo queue and job-state queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmatch.operators import aggregates as A
from shelfmatch.operators import feedback as O
from shelfmatch.operators import joins as J
from shelfmatch.operators import ranking as R
from shelfmatch.operators import windows as W
from shelfmatch.sources import reports
from shelfmatch.workload.base import CARD_URL, DERIVED, VIEWS, Tables, query, rounded

NOW = "2024-02-01 00:00:00"
TABLE = [c.split()[0] for c in O.FEEDBACK_SCHEMA.split(", ")]

# One stored row per user: the job's state before the new votes.
VIEWS["stored_feedback"] = """
SELECT CAST(user_id AS VARCHAR) AS job_id, 'slug-' || user_id % 3 AS correct_slug, user_id % 2 = 0 AS is_correct,
  CASE user_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' ELSE 'unlabeled' END AS embedding_state,
  CASE WHEN user_id % 4 = 0 THEN 'approved' ELSE 'pending' END AS review_status, CAST(user_id % 5 AS INTEGER) AS label_revision,
  CASE WHEN user_id % 4 = 0 THEN '/data/reference/feedback/' || user_id % 7 || '.png' END AS reference_uri
FROM events WHERE event_type <> 'signup' GROUP BY user_id
"""


def stored_feedback(t: Tables):
    user = F.col("user_id")
    state = F.when(user % 4 == 0, "ready").when(user % 4 == 1, "failed").when(user % 4 == 2, "queued").otherwise("unlabeled")
    jobs = t.events.where("event_type <> 'signup'").groupBy("user_id").agg(F.min("ts").alias("ts"))
    return jobs.select(
        user.cast("string").alias("job_id"), F.sha2(user.cast("string"), 256).alias("image_sha256"), F.lit("slug-1").alias("predicted_slug"),
        (user % 2 == 0).alias("is_correct"), F.concat(F.lit("slug-"), (user % 3).cast("string")).alias("correct_slug"),
        F.when(user % 4 == 0, "approved").otherwise("pending").alias("review_status"), state.alias("embedding_state"),
        F.lit(None).cast("string").alias("embedding_error"),
        F.when(user % 4 == 0, F.concat(F.lit("/data/reference/feedback/"), user % 7, F.lit(".png"))).alias("reference_uri"),
        F.when(user % 4 == 0, F.concat(F.lit("slug-"), (user % 3).cast("string"))).alias("indexed_slug"),
        (user % 5).cast("int").alias("label_revision"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def samples(t: Tables):
    """One stored photo per user; its bytes are the user id."""
    return t.events.groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("image_sha256"),
        F.encode(F.col("user_id").cast("string"), "utf-8").alias("image_bytes"), "created_at")


for _view in (stored_feedback, samples):
    DERIVED[_view.__name__] = _view
VOTES = ["votes", "stored_feedback"]


@query("""
SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS incorrect, count(correct_slug) AS labeled,
  count(*) FILTER (review_status = 'pending') AS pending_review, count(*) FILTER (embedding_state = 'ready') AS indexed,
  count(*) FILTER (embedding_state IN ('queued', 'indexing')) AS indexing, count(*) FILTER (embedding_state = 'failed') AS index_failed FROM feedback
""", ["feedback"])
def feedback_stats(t: Tables):
    return A.feedback_stats(t.feedback)


@query("""
SELECT f.job_id, f.image_sha256, CAST(s.user_id AS VARCHAR) AS photo FROM feedback f JOIN (SELECT DISTINCT user_id FROM events) s ON f.image_sha256 = sha256(CAST(s.user_id AS VARCHAR))
""", ["feedback"])
def feedback_with_samples(t: Tables):
    rows = J.feedback_with_samples(t.feedback.select("job_id", "image_sha256"), t.samples.drop("created_at"))
    return rows.select("job_id", "image_sha256", F.decode("image_bytes", "utf-8").alias("photo"))


@query("""
SELECT DISTINCT image_sha256, correct_slug AS label FROM feedback f WHERE embedding_state = 'ready' AND correct_slug IS NOT NULL
  AND (SELECT count(DISTINCT correct_slug) FROM feedback o WHERE o.image_sha256 = f.image_sha256 AND o.embedding_state = 'ready') > 1
""", ["feedback"])
def label_conflicts(t: Tables):
    return J.label_conflicts(t.feedback).select("image_sha256", "label")


@query("""
SELECT uri AS image_uri FROM (SELECT DISTINCT '/data/reference/feedback/' || user_id || '/' || event_id % 5 || '.png' AS uri FROM events) WHERE uri NOT IN (
  SELECT reference_uri FROM feedback WHERE reference_uri IS NOT NULL)
""", ["feedback"])
def unreferenced(t: Tables):
    refs = t.events.select(F.concat(
        F.lit("/data/reference/feedback/"), "user_id", F.lit("/"), F.col("event_id") % 5, F.lit(".png")).alias("image_uri")).distinct()
    return J.unreferenced(refs, t.feedback)


@query("SELECT job_id, updated_us FROM feedback WHERE embedding_state = 'queued' ORDER BY updated_us, job_id", ["feedback"])
def queue_order(t: Tables):
    return R.queue_order(t.feedback).select("job_id", "updated_us")


@query("""
SELECT job_id, CASE WHEN embedding_state = 'indexing' OR (embedding_state = 'unlabeled' AND correct_slug IS NOT NULL) THEN 'queued' ELSE embedding_state END AS embedding_state FROM feedback
""", ["feedback"])
def recover_queue(t: Tables):
    return O.recover_queue(t.feedback).select("job_id", "embedding_state")


@query("""
SELECT v.job_id, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN label END AS correct_slug FROM (
  SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN ok THEN 'slug-1' ELSE slug END AS label,
    CASE WHEN ok AND slug <> 'slug-1' THEN 'correct_vote_names_other_item' WHEN NOT ok AND slug = 'slug-1' THEN 'correction_equals_prediction'
      WHEN NOT ok AND slug IS NULL THEN 'label_missing' WHEN slug = 'slug-2' AND NOT ok THEN 'unknown_slug' END AS reason
  FROM (SELECT event_id, event_type IN ('view', 'click') AS ok, CASE WHEN event_type <> 'purchase' THEN 'slug-' || CAST(floor(value) AS BIGINT) % 3 END AS slug FROM events)) v
""")
def label_accept(t: Tables):
    known = t.region.limit(0).select(F.lit("").alias("slug")).unionByName(t.feedback.select(F.col("predicted_slug").alias("slug")).distinct()).unionByName(
        t.feedback.where("correct_slug = 'slug-0'").select(F.col("correct_slug").alias("slug")).distinct())
    votes = t.feedback.select("job_id", "is_correct", "correct_slug")
    good, bad = O.label_accept(votes, t.feedback.select("job_id", "predicted_slug"), known, CARD_URL)
    return good.select("job_id", F.lit("ok").alias("reason"), "correct_slug").unionByName(
        bad.select("job_id", "reason", F.lit(None).cast("string").alias("correct_slug")))


FOLDED = """
SELECT job_id, last_ok AS is_correct, last_label AS correct_slug,
  CASE WHEN had AND NOT new THEN review_status WHEN had AND vote_changes = 0 THEN review_status ELSE 'pending' END AS review_status,
  CASE WHEN label_changes > 0 THEN 'queued' WHEN NOT had AND first_label IS NOT NULL THEN 'queued' WHEN NOT had THEN 'unlabeled'
    WHEN embedding_state = 'failed' THEN 'queued' ELSE embedding_state END AS embedding_state,
  coalesce(label_revision, 0) + label_changes AS label_revision, CASE WHEN label_changes = 0 THEN reference_uri END AS reference_uri
FROM (SELECT v.job_id, true AS new, arg_max(v.is_correct, v.seq) AS last_ok, max_by(struct_pack(l := v.correct_slug), v.seq).l AS last_label,
    min_by(struct_pack(l := v.correct_slug), v.seq).l AS first_label,
    count(*) FILTER (has AND v.correct_slug IS DISTINCT FROM pl) AS label_changes,
    count(*) FILTER (has AND (v.correct_slug IS DISTINCT FROM pl OR v.is_correct IS DISTINCT FROM po)) AS vote_changes
  FROM (SELECT v.*, s.job_id IS NOT NULL OR lag(v.seq) OVER w IS NOT NULL AS has,
      CASE WHEN lag(v.seq) OVER w IS NOT NULL THEN lag(v.correct_slug) OVER w ELSE s.correct_slug END AS pl,
      CASE WHEN lag(v.seq) OVER w IS NOT NULL THEN lag(v.is_correct) OVER w ELSE s.is_correct END AS po
    FROM votes v LEFT JOIN stored_feedback s USING (job_id) WINDOW w AS (PARTITION BY v.job_id ORDER BY v.seq)) v GROUP BY 1)
LEFT JOIN (SELECT *, true AS had0 FROM stored_feedback) s USING (job_id), LATERAL (SELECT coalesce(had0, false) AS had)
"""


@query(FOLDED, VOTES)
def upsert_feedback(t: Tables):
    return O.upsert_feedback(t.stored_feedback, t.votes)[0].select(
        "job_id", "is_correct", "correct_slug", "review_status", "embedding_state", "label_revision", "reference_uri")


@query(f"""
SELECT image_uri FROM (SELECT DISTINCT '/data/reference/feedback/' || user_id % 7 || '.png' AS image_uri FROM events UNION SELECT '/data/reference/catalog/1.png')
WHERE image_uri NOT IN (SELECT reference_uri FROM stored_feedback s WHERE reference_uri IS NOT NULL AND EXISTS (SELECT 1 FROM ({FOLDED}) f WHERE f.job_id = s.job_id AND f.reference_uri IS NULL))
  OR image_uri IN (SELECT reference_uri FROM ({FOLDED}) WHERE reference_uri IS NOT NULL)
""", VOTES)
def retract_reference(t: Tables):
    after, retired = O.upsert_feedback(t.stored_feedback, t.votes)
    refs = t.events.select(F.concat(F.lit("/data/reference/feedback/"), F.col("user_id") % 7, F.lit(".png")).alias("image_uri")).distinct()
    return O.retract_reference(refs.union(t.region.limit(1).select(F.lit("/data/reference/catalog/1.png"))), after, retired)


PUBLISH = """
SELECT * FROM (WITH r AS (SELECT f.*, CASE WHEN user_id % 9 = 0 THEN 'model crashed' END AS error FROM feedback f WHERE label_revision = 2),
ready AS (SELECT image_sha256, min(correct_slug) AS lo, max(correct_slug) AS hi FROM feedback WHERE embedding_state = 'ready' AND correct_slug IS NOT NULL GROUP BY 1),
u AS (SELECT r.*, coalesce(lo <> correct_slug OR hi <> correct_slug, false) AS against FROM r LEFT JOIN ready USING (image_sha256)),
lead AS (SELECT image_sha256, arg_min(correct_slug, (updated_us, job_id)) AS leader FROM u WHERE error IS NULL AND correct_slug IS NOT NULL AND NOT against GROUP BY 1),
j AS (SELECT job_id, correct_slug, error IS NOT NULL OR (correct_slug IS NOT NULL AND (against OR correct_slug <> coalesce(leader, correct_slug))) AS fails FROM u LEFT JOIN lead USING (image_sha256))
SELECT f.job_id, CASE WHEN j.job_id IS NULL THEN f.embedding_state WHEN NOT fails AND f.correct_slug IS NOT NULL THEN 'ready' WHEN NOT fails THEN 'unlabeled'
    WHEN f.embedding_state = 'indexing' THEN 'failed' ELSE f.embedding_state END AS embedding_state,
  CASE WHEN j.job_id IS NULL OR fails THEN f.review_status WHEN f.correct_slug IS NOT NULL THEN 'approved' ELSE 'pending' END AS review_status
FROM feedback f LEFT JOIN j USING (job_id))
"""


def _publication(t: Tables):
    feedback = t.feedback.select(*TABLE)
    results = t.feedback.select(
        "job_id", F.lit(2).alias("revision"), F.md5("job_id").alias("digest"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"),
        F.lit("visual-a").alias("model_name"), F.when(F.col("user_id") % 9 == 0, "model crashed").alias("error"))
    catalog = t.feedback.where("correct_slug is not null").groupBy(F.col("correct_slug").alias("slug")).agg(F.min(F.col("job_id").cast("long")).alias("id"))
    stamp = F.lit(NOW).cast("timestamp")
    refs = t.feedback.where("reference_uri is not null").groupBy(F.col("reference_uri").alias("image_uri")).agg(F.min(F.col("job_id").cast("long")).alias("id")).select(
        "id", F.lit("0").alias("item_id"), F.lit("slug-0").alias("slug"), "image_uri", F.lit("visual-a").alias("model_name"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return O.publish_feedback(feedback, refs, catalog, results, "visual-a", 2, stamp)


@query(PUBLISH, ["feedback"])
def publish_feedback(t: Tables):
    return _publication(t)[0].select("job_id", "embedding_state", "review_status")


@query("""
SELECT * FROM (WITH ready AS (SELECT image_sha256, min(correct_slug) AS lo, max(correct_slug) AS hi FROM feedback WHERE embedding_state = 'ready' AND correct_slug IS NOT NULL GROUP BY 1),
item AS (SELECT correct_slug, CAST(min(CAST(job_id AS BIGINT)) AS VARCHAR) AS item_id FROM feedback WHERE correct_slug IS NOT NULL GROUP BY 1),
u AS (SELECT f.*, item_id, user_id % 9 = 0 AS crashed, coalesce(lo <> f.correct_slug OR hi <> f.correct_slug, false) AS against
  FROM feedback f LEFT JOIN ready USING (image_sha256) LEFT JOIN item USING (correct_slug) WHERE label_revision = 2),
lead AS (SELECT image_sha256, arg_min(correct_slug, (updated_us, job_id)) AS leader FROM u WHERE NOT crashed AND correct_slug IS NOT NULL AND NOT against GROUP BY 1),
j AS (SELECT u.job_id, u.correct_slug, item_id, reference_uri AS old_uri,
    crashed OR (correct_slug IS NOT NULL AND (against OR correct_slug <> coalesce(leader, correct_slug))) AS fails,
    CASE WHEN correct_slug IS NOT NULL THEN '/data/reference/feedback/' || item_id || '/' || md5(u.job_id) || '.png' END AS uri
  FROM u LEFT JOIN lead USING (image_sha256)),
stored AS (SELECT min(CAST(job_id AS BIGINT)) AS id, reference_uri AS image_uri FROM feedback WHERE reference_uri IS NOT NULL GROUP BY 2),
merged AS (SELECT id, '0' AS item_id, 'slug-0' AS slug, image_uri FROM stored
  UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM stored) + row_number() OVER (ORDER BY md5(uri), uri), item_id, correct_slug, uri FROM j WHERE NOT fails AND uri IS NOT NULL),
used AS (SELECT CASE WHEN j.job_id IS NOT NULL AND NOT fails THEN uri ELSE f.reference_uri END AS image_uri FROM feedback f LEFT JOIN j USING (job_id))
SELECT * FROM merged m WHERE NOT (
  EXISTS (SELECT 1 FROM j WHERE NOT fails AND old_uri = m.image_uri AND old_uri IS DISTINCT FROM uri AND starts_with(old_uri, '/data/reference/feedback/'))
  AND NOT EXISTS (SELECT 1 FROM used WHERE used.image_uri = m.image_uri)))
""", ["feedback"])
def publish_feedback_references(t: Tables):
    return _publication(t)[1].select("id", "item_id", "slug", "image_uri")


@query("SELECT job_id FROM feedback WHERE label_revision = 2", ["feedback"])
def drop_stale_results(t: Tables):
    results = t.feedback.select("job_id", F.lit(2).alias("revision"))
    return O.drop_stale_results(results, t.feedback).select("job_id")


@query("SELECT sha256(CAST(user_id AS VARCHAR)) AS image_sha256, min(epoch_us(ts)) AS created_us FROM events GROUP BY user_id")
def dedupe_samples(t: Tables):
    incoming = t.events.select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("image_sha256"), F.encode(F.col("user_id").cast("string"), "utf-8").alias("image_bytes"),
        F.col("ts").alias("created_at"))
    stored = t.samples.where(F.col("image_sha256") < "8")
    return O.dedupe_samples(stored, incoming).select("image_sha256", F.unix_micros("created_at").alias("created_us"))


@query("""
SELECT job_id, image_sha256 || '' AS image_path, correct_slug, review_status FROM feedback WHERE correct_slug IS NOT NULL AND review_status <> 'rejected'
""", ["feedback"])
def export_feedback_jsonl(t: Tables):
    return reports.exportable_feedback(t.feedback, t.samples).select("job_id", "image_path", "correct_slug", "review_status")


@query("""
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS stage, max(value) OVER w AS progress,
  CAST(round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000) AS BIGINT) AS elapsed_ms,
  CAST(round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000) AS BIGINT) AS stage_ms
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def stage_progress(t: Tables):
    events = t.events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"),
        F.col("value").alias("progress"))
    return W.stage_progress(events)


STAGES = """
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, value / 100 AS progress,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE event_type END AS stage FROM events
"""


@query(f"""
SELECT e.job_id, e.seq, e.stage, epoch_us(e.ts) AS updated_us, greatest(0.0, max(e.progress) OVER w) AS progress,
  CASE WHEN (e.ts, e.seq) >= (f.ts, f.seq) THEN f.stage WHEN e.stage = 'queued' THEN 'queued' ELSE 'processing' END AS state,
  CAST(floor((epoch_us(e.ts) - min(epoch_us(e.ts)) OVER (PARTITION BY e.job_id)) / 1000 + 0.5) AS BIGINT) AS elapsed_ms
FROM ({STAGES}) e LEFT JOIN (
  SELECT * FROM ({STAGES}) WHERE stage IN ('done', 'failed') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) = 1) f ON f.job_id = e.job_id
WINDOW w AS (PARTITION BY e.job_id ORDER BY e.ts, e.seq)
""")
def job_states(t: Tables):
    states = W.job_states(stage_events(t.events))
    return states.select("job_id", "seq", "stage", F.unix_micros("updated_at").alias("updated_us"), "progress", "state", "elapsed_ms")


def stage_events(events):
    """Events as stages of jobs: purchases finish a job, errors fail it."""
    kind = F.col("event_type")
    stage = F.when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise(kind)
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", stage.alias("stage"), (F.col("value") / 100).alias("progress"))


@query("""
SELECT job_id, min_by(struct_pack(l := correct_slug), seq).l IS NOT NULL OR count(*) FILTER (changed) > 0 AS queued, arg_max(is_correct, seq) AS is_correct,
  max_by(struct_pack(l := correct_slug), seq).l AS correct_slug, count(*) FILTER (changed) AS label_revision,
  max_by(before, seq) FILTER (changed AND before IS NOT NULL) AS retired_label, max(seq) AS seq
FROM (SELECT *, lag(seq) OVER w IS NOT NULL AND correct_slug IS DISTINCT FROM lag(correct_slug) OVER w AS changed, lag(correct_slug) OVER w AS before
  FROM votes WINDOW w AS (PARTITION BY job_id ORDER BY seq)) GROUP BY job_id
""", ["votes"])
def fold_votes(t: Tables):
    # Replayed votes change nothing.
    rows = O.fold_votes(t.votes.unionByName(t.votes))
    return rows.select("job_id", (F.col("embedding_state") == "queued").alias("queued"), "is_correct", "correct_slug", "label_revision", "retired_label", "seq")


@query("""
SELECT job_id FROM (
  SELECT *, row_number() OVER (PARTITION BY done ORDER BY ts, job_id) AS oldest, count(*) OVER () AS n FROM (
    SELECT event_id AS job_id, ts, event_type IN ('purchase', 'error') AS done FROM events) WHERE NOT done OR epoch(TIMESTAMP '2024-01-31') - epoch(ts) <= 864000)
WHERE NOT done OR oldest > n - (7000 - 1)
""")
def retain_jobs(t: Tables):
    done = F.col("event_type").isin("purchase", "error")
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.when(done, F.col("ts")).alias("completed_at"))
    return W.retain_jobs(jobs, "2024-01-31 00:00:00+00:00", 864_000, 7000).select("job_id")


@query("""
SELECT event_type AS stage, count(*) AS count, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1
""")
def latency_percentiles(t: Tables):
    return rounded(A.latency_percentiles(t.events.select(F.col("event_type").alias("stage"), "value"), ["stage"], "value"))


@query("""
SELECT count(*) FILTER (event_type = 'view') AS inserted, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type = 'signup') AS skipped,
  0 AS deleted, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('view', 'click')) AS processed,
  count(*) FILTER (event_type IN ('view', 'click', 'signup', 'error')) AS total, 'partial' AS status FROM events
""", big=["deleted"])
def indexing_stats(t: Tables):
    kind = F.col("event_type")
    outcome = F.when(kind == "view", "inserted").when(kind == "click", "updated").when(kind == "signup", "skipped").when(kind == "error", "error")
    return A.indexing_stats(t.events.select(outcome.alias("outcome")))
