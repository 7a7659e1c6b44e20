import pytest
from pyspark.sql import functions as F

from shelfmatch.operators import feedback as O
from shelfmatch.operators import maintain as M
from shelfmatch.operators import validate as V

CATALOG = (
    "id long, name string, category string, color string, region string, grape_variety string, description string, winery string, "
    "slug string, dataset_photo string, source_data map<string,string>, web_photo string, web_photo_url string, "
    "dataset_photo_embedding array<float>, dataset_photo_embedding_model string, description_text_embedding array<float>, "
    "description_text_embedding_model string, web_photo_embedding array<float>, web_photo_embedding_model string, "
    "import_source string, source_row_number long"
)
INCOMING = (
    "name string, category string, color string, region string, grape_variety string, description string, winery string, "
    "slug string, dataset_photo string, source_data map<string,string>, import_source string, source_row_number long"
)


def incoming(spark, rows):
    return spark.createDataFrame([(n, None, None, None, None, None, "w", s, p, {"k": "v"}, "src", r) for n, s, p, r in rows], INCOMING)


def test_import_is_idempotent_and_resets_only_changed_inputs(spark):
    empty = spark.createDataFrame([], CATALOG)
    first = M.upsert_catalog(empty, incoming(spark, [("a", "s1", "1.jpg", 2), ("b", "s2", "2.jpg", 3), ("c", "s2", "3.jpg", 4)]))
    assert sorted((r["id"], r["source_row_number"]) for r in first.collect()) == [(1, 2), (2, 3), (3, 4)]
    vectors = first.select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    full = first
    for kind in M.KINDS:
        full = M.store_vectors(full, vectors, kind, "m")
    same = M.upsert_catalog(full, incoming(spark, [("a", "s1", "1.jpg", 2), ("b", "s2", "2.jpg", 3), ("c", "s2", "3.jpg", 4)]))
    assert sorted(map(str, same.collect())) == sorted(map(str, full.collect()))
    changed = M.upsert_catalog(full, incoming(spark, [("A", "s1", "1.jpg", 2), ("b", "s9", "2.jpg", 3), ("c", "s2", None, 4), ("d", "s4", "4.jpg", 5)]))
    got = {r["source_row_number"]: tuple(r[f"{k}_embedding_model"] for k in M.KINDS) for r in changed.collect()}
    assert got == {2: ("m", None, "m"), 3: ("m", "m", None), 4: (None, "m", "m"), 5: (None, None, None)}
    assert M.trim_source_tail(changed, "src", 3).count() == 2
    pending = V.pending_embeddings(changed, None, "dataset_photo", "m")
    assert [r["source_row_number"] for r in pending.collect()] == [5]


def test_text_vectors_of_names_stay_when_other_attributes_change(spark):
    base = M.upsert_catalog(spark.createDataFrame([], CATALOG), incoming(spark, [("a", "s1", "1.jpg", 2), ("b", "s1", "2.jpg", 3)]))
    full = M.store_vectors(base, base.select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")), "description_text", "m")
    other = incoming(spark, [("a", "s1", "1.jpg", 2), ("B", "s1", "2.jpg", 3)]).withColumn("category", F.lit("red"))
    model = lambda df: {r["source_row_number"]: r["description_text_embedding_model"] for r in df.collect()}
    assert model(M.upsert_catalog(full, other, ["name"])) == {2: "m", 3: None}
    assert model(M.upsert_catalog(full, other)) == {2: None, 3: None}


def test_query_follows_its_sql_where_rows_meet_other_products(spark, tmp_path):
    """A moved row number of one product is the stored one of another product of the same name."""
    import __spark_entry__ as entry
    from tests.compare import compare

    rows = [(3, "cold bolt", "b1", "SMALL", 13, 1.0), (1_000_003, "cold bolt", "b2", "LARGE", 6, 1.0), (5, "new", "b1", "SMALL", 4, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    ok, message = compare(spark, con, "upsert_catalog", entry.queries(), entry.oracle_sql(), str(tmp_path))
    assert ok, message


def test_scrape_result_resets_vector_only_when_photo_changes(spark):
    base = M.upsert_catalog(spark.createDataFrame([], CATALOG), incoming(spark, [("a", "s1", "1.jpg", 2), ("b", "s1", "2.jpg", 3), ("c", "s2", "3.jpg", 4)]))
    pages = spark.createDataFrame([("s1", "s1.jpg", "https://x/s1.jpg")], "slug string, web_photo string, web_photo_url string")
    once = M.apply_scrape_result(base, pages)
    embedded = M.store_vectors(once, once.select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")), "web_photo", "m")
    again = M.apply_scrape_result(embedded, pages)
    assert again.where("web_photo_embedding_model = 'm'").count() == 3
    moved = M.apply_scrape_result(embedded, pages.withColumn("web_photo_url", F.lit("https://y")))
    assert moved.where("web_photo_embedding is null and slug = 's1'").count() == 2


def test_track_jobs(spark):
    jobs = spark.createDataFrame([("a", "failed", 1, "old", None)], "slug string, status string, attempts int, last_error string, updated_at timestamp")
    rows = [("a", "succeeded", None, 1), ("b", "failed", "x" * 5000, 1), ("b", "failed", "last", 2)]
    outcomes = spark.createDataFrame(rows, "slug string, status string, error string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["slug"]: (r["status"], r["attempts"], r["last_error"]) for r in M.track_jobs(jobs, outcomes, ["slug"]).collect()}
    assert got == {"a": ("succeeded", 2, None), "b": ("failed", 2, "last")}


REFS = "id long, item_id string, slug string, image_uri string, model_name string, embedding array<float>, created_at timestamp, updated_at timestamp"
SOURCE = "position int, item_id string, slug string, image_uri string, path string, model_name string, embedding array<float>, error string"


def test_index_run_prunes_safely(spark):
    refs = spark.createDataFrame([(1, "1", "a", "/d/1", "m", [1.0], None, None), (2, "2", "b", "/d/2", "m", [1.0], None, None),
                                  (3, "3", "c", "/d/3", "m", [1.0], None, None), (4, "4", "d", "/d/4", "other", [1.0], None, None)], REFS)
    now = F.lit("2024-01-01").cast("timestamp")
    rows = [(1, "1", "a", "/d/1", "/d/1", "m", [2.0], None), (2, "1", "a", "/d/./1", "/d/1", "m", [2.0], None),
            (3, "3", "c", "/d/3", "/d/3", "m", None, "broken"), (4, "9", "z", "/d/9", "/d/9", "m", [2.0], None)]
    table, stats = M.index_run(refs, spark.createDataFrame(rows, SOURCE), "m", now, prune=True)
    assert sorted(r["image_uri"] for r in table.collect()) == ["/d/1", "/d/3", "/d/4", "/d/9"]
    s = stats.first()
    assert (s["inserted"], s["updated"], s["skipped"], s["deleted"], s["errors"], s["status"]) == (1, 1, 1, 1, 1, "partial")
    table, stats = M.index_run(refs, spark.createDataFrame(rows[2:3], SOURCE), "m", now, prune=True)
    assert table.count() == 4 and stats.first()["status"] == "failed" and stats.first()["deleted"] == 0


def test_publication_is_checked(spark):
    base = M.upsert_catalog(spark.createDataFrame([], CATALOG), incoming(spark, [("a", "s1", "1.jpg", 2), ("b", "s1", "1.jpg", 3)]))
    manifest = spark.createDataFrame([("1.jpg", "up/1.JPG")], "dataset_photo string, relative_path string")
    refs, now = spark.createDataFrame([], REFS), F.lit("2024-01-01").cast("timestamp")
    with pytest.raises(ValueError, match="refusing empty"):
        M.publish_references(base, manifest, refs, "m", 1, "/data", now)
    vectors = base.select("id", F.array(F.col("id")).cast("array<float>").alias("embedding"))
    ready = M.store_vectors(base, vectors, "dataset_photo", "m")
    table, _ = M.publish_references(ready, manifest, refs, "m", 1, "/data", now)
    rows = table.collect()
    assert len(rows) == 1 and rows[0]["item_id"] == "1" and rows[0]["embedding"] == [2.0] and rows[0]["image_uri"].endswith(".jpg")
    with pytest.raises(Exception, match="Wrong vector dimension"):
        M.catalog_references(ready, manifest, "m", 2, "/data").collect()
    with pytest.raises(Exception, match="No matched file"):
        M.catalog_references(ready, manifest.limit(0), "m", 1, "/data").collect()


VOTES = "job_id string, image_sha256 string, predicted_slug string, is_correct boolean, correct_slug string, seq long, t long"


def votes(spark, rows):
    full = [(j, f"h{j}", "p", ok, label, seq, seq) for j, ok, label, seq in rows]
    return spark.createDataFrame(full, VOTES).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def state(df):
    return {r["job_id"]: (r["is_correct"], r["correct_slug"], r["review_status"], r["embedding_state"], r["label_revision"]) for r in df.collect()}


def test_votes_fold_like_single_updates(spark):
    empty = spark.createDataFrame([], O.FEEDBACK_SCHEMA)
    rows = [("a", True, "p", 1), ("b", False, None, 2), ("a", True, "p", 3), ("b", False, "x", 4), ("b", False, "y", 5), ("a", False, "z", 6), ("c", False, None, 7)]
    batch = O.upsert_feedback(empty, votes(spark, rows))[0]
    single = empty
    for row in rows:
        single = spark.createDataFrame(O.upsert_feedback(single, votes(spark, [row]))[0].collect(), O.FEEDBACK_SCHEMA)
    assert state(batch) == state(single) == {
        "a": (False, "z", "pending", "queued", 1), "b": (False, "y", "pending", "queued", 2), "c": (False, None, "pending", "unlabeled", 0)}


def test_feedback_review_and_retraction(spark):
    ready = spark.createDataFrame([
        ("a", "ha", "p", True, "p", "approved", "ready", None, "/data/reference/feedback/1/a.png", "p", 0, None, None),
        ("b", "hb", "p", True, "p", "approved", "ready", None, "/data/reference/feedback/1/a.png", "p", 0, None, None),
        ("c", "hc", "p", True, "p", "pending", "failed", "e", "/data/reference/catalog/c.png", "p", 3, None, None),
    ], O.FEEDBACK_SCHEMA)
    refs = spark.createDataFrame([(1, "1", "p", u, "m", [1.0], None, None) for u in (
        "/data/reference/feedback/1/a.png", "/data/reference/catalog/c.png")], REFS)
    same, retired = O.upsert_feedback(ready, votes(spark, [("a", True, "p", 1), ("c", True, "p", 2)]))
    assert state(same)["a"] == (True, "p", "approved", "ready", 0) and state(same)["c"][3] == "queued" and retired.count() == 0
    one, retired = O.upsert_feedback(ready, votes(spark, [("a", False, "x", 1), ("c", False, "x", 2)]))
    assert O.retract_reference(refs, one, retired).count() == 2
    both, retired = O.upsert_feedback(ready, votes(spark, [("a", False, "x", 1), ("b", False, None, 2), ("c", False, "x", 3)]))
    assert [r["image_uri"] for r in O.retract_reference(refs, both, retired).collect()] == ["/data/reference/catalog/c.png"]


def test_publish_feedback_conflicts_and_stale(spark):
    row = lambda j, h, label, st, rev, t, uri=None: (j, h, "p", False, label, "pending", st, None, uri, None, rev, None, t)
    from datetime import datetime

    at = lambda n: datetime(2024, 1, 1, 0, n)
    feedback = spark.createDataFrame([
        row("a", "h1", "x", "indexing", 1, at(1)), row("b", "h1", "y", "indexing", 0, at(2)), row("c", "h2", "x", "ready", 0, at(0)),
        row("d", "h2", "y", "indexing", 0, at(3)), row("e", "h3", "x", "queued", 2, at(4)), row("f", "h4", None, "indexing", 1, at(5), "/data/reference/feedback/9/old.png"),
        row("g", "h5", "gone", "indexing", 0, at(6)), row("h", "h6", "x", "indexing", 0, at(7)),
    ], O.FEEDBACK_SCHEMA)
    catalog = spark.createDataFrame([(5, "x"), (4, "x"), (7, "y")], "id long, slug string")
    refs = spark.createDataFrame([(1, "9", "x", "/data/reference/feedback/9/old.png", "m", [1.0], None, None)], REFS)
    results = spark.createDataFrame(
        [(j, rev, f"d{j}", [1.0] if j != "h" else [0.0], "m", None) for j, rev in (("a", 1), ("b", 0), ("d", 0), ("e", 1), ("f", 1), ("g", 0), ("h", 0))],
        "job_id string, revision int, digest string, embedding array<float>, model_name string, error string")
    updated, table = O.publish_feedback(feedback, refs, catalog, results, "m", 1, F.lit("2024-01-02").cast("timestamp"))
    got = {r["job_id"]: (r["embedding_state"], r["review_status"], r["reference_uri"]) for r in updated.collect()}
    assert got == {
        "a": ("ready", "approved", "/data/reference/feedback/4/da.png"), "b": ("failed", "pending", None), "c": ("ready", "pending", None),
        "d": ("failed", "pending", None), "e": ("queued", "pending", None), "f": ("unlabeled", "pending", None), "g": ("failed", "pending", None),
        "h": ("failed", "pending", None)}
    assert [(r["item_id"], r["image_uri"]) for r in table.collect()] == [("4", "/data/reference/feedback/4/da.png")]


def test_publication_meets_photos_and_jobs_once(spark):
    from __spark_entry__ import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()["publish_feedback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(image_sha256") <= 2 and "LeftSemi" not in plan
