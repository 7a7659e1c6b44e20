import hashlib
import random

from pyspark.sql import functions as F

from shelfmatch.operators.maintain import settle_scrapes
from shelfmatch.plans.recognition import recognition_answers
from shelfmatch.sources.files import digest_of, with_digests
from shelfmatch.sources.tables import file_manifest
from tests.test_maintain import CATALOG


def test_digests_do_not_depend_on_the_range(spark, tmp_path):
    data = random.Random(1).randbytes(3_000_001)
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "large.bin").write_bytes(data)
    (folder / "empty.bin").write_bytes(b"")
    want = {"large.bin": hashlib.sha256(data).hexdigest(), "empty.bin": hashlib.sha256(b"").hexdigest()}
    for size in (1000, 1 << 20, len(data), 1 << 26):
        assert digest_of(str(folder / "large.bin"), size) == want["large.bin"]
    # Spark's readers leave empty files out.
    assert {r.file: r.sha256 for r in file_manifest(spark, str(folder)).collect()} == {"large.bin": want["large.bin"]}
    files = spark.createDataFrame([(str(folder / n), 7) for n in want], "path string, length long")
    assert {r.sha256 for r in with_digests(files, range_bytes=999).collect()} == set(want.values())


def test_scraped_jobs_are_done_with_their_rows(spark):
    empty = spark.createDataFrame([], CATALOG)
    filled = {"id": F.col("id"), "slug": F.concat(F.lit("s"), F.col("id").cast("string"))}
    catalog = spark.range(1, 4).select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
    jobs = spark.createDataFrame(
        [("s1", "failed", 2, "timeout", None, None), ("s2", "pending", 0, None, None, None), ("s9", "failed", 1, "gone", None, None)],
        "slug string, status string, attempts int, last_error string, processed_at timestamp, updated_at timestamp")
    pages = spark.createDataFrame([("s1", "1.jpg", "u1"), ("s1", "0.jpg", "u0"), ("s3", "3.jpg", "u3")], "slug string, web_photo string, web_photo_url string")
    after, settled = settle_scrapes(catalog, jobs, pages, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert {r.slug: r.web_photo for r in after.collect()} == {"s1": "0.jpg", "s2": None, "s3": "3.jpg"}
    rows = {r.slug: (r.status, r.attempts, r.last_error, r.processed_at is not None) for r in settled.collect()}
    assert rows == {"s1": ("succeeded", 2, None, True), "s2": ("pending", 0, None, False), "s9": ("failed", 1, "gone", False)}


def test_answers_carry_the_whole_card(spark):
    decisions = spark.createDataFrame([(1, "a b*~é", 0.7, "ok"), (2, None, None, "visual_retrieval_unavailable")], "query_id long, slug string, text_weight double, status string")
    cards = spark.createDataFrame([("a b*~é", "Name", 1990, "x")], "slug string, name string, vintage int, extra string")
    evidence = spark.createDataFrame([(1, "seen", [1990])], "query_id long, text string, years array<int>")
    one, two = recognition_answers(decisions, cards, evidence, "https://c.example.org/items/", "v1").orderBy("query_id").collect()
    assert one.card.asDict() == {"slug": "a b*~é", "name": "Name", "vintage": 1990, "extra": "x"}
    assert one.item_url == "https://c.example.org/items/a%20b%2A~%C3%A9" and tuple(one.weights) == (0.3, 0.7) and one.evidence.years == [1990]
    assert two.card is None and two.item_url is None and two.weights is None and two.evidence is None and two.pipeline_version == "v1"
