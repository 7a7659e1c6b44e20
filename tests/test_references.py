"""Photos of requested items."""

from collections import Counter

from pyspark.sql import functions as F

from shelfmatch.operators import joins as J


def test_rows_of_one_item_are_made_in_many_tasks(spark):
    """One task reads each table; all queries ask for one item, whose photos hold copies and a null."""
    ids = spark.range(0, 3000, 1, 1).select(F.col("id").alias("query_id"), F.lit("a").alias("item_id"))
    photos = spark.range(0, 2500, 1, 1).select(
        F.lit("a").alias("item_id"), F.when(F.col("id") > 0, F.concat(F.lit("p"), F.greatest(F.lit(10), "id"))).alias("image_uri"))
    found, missing = J.references_by_item(ids, photos)
    made = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 3000 * 2500
    assert max(r["count"] for r in made) <= 0.7 * 3000 * 2500
    counts = found.groupBy("image_uri").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("d")).collect()
    assert {r["n"] for r in counts if r["image_uri"] != "p10"} == {3000} == {r["d"] for r in counts}
    assert len(counts) == 2491 and {r["n"] for r in counts if r["image_uri"] == "p10"} == {30_000}
    assert missing.count() == 0


def test_references_by_item_equals_a_plain_join(spark):
    asked = [(q, i, q * 7) for q in range(40) for i in ("a", "b", "none", None)] + [(1, "a", 7)]
    photos = [("a", "1"), ("a", "1"), ("b", None), ("unasked", "2"), (None, "3")]
    ids = spark.createDataFrame(asked, "query_id long, item_id string, request_order long")
    found, missing = J.references_by_item(ids, spark.createDataFrame(photos, "item_id string, image_uri string"))
    want = Counter((i, q, o, u) for q, i, o in asked for item, u in photos if item == i and i)
    assert Counter(tuple(r) for r in found.collect()) == want and found.columns == ["item_id", "query_id", "request_order", "image_uri"]
    assert Counter(tuple(r) for r in missing.select("query_id", "item_id").collect()) == Counter((q, i) for q, i, _ in asked if i in ("none", None))


def test_files_of_pairs_take_little_disk(spark, tmp_path):
    """Rows of a cell come in an order that lets columns repeat; the result grows with the square of its tables."""
    ids = spark.range(0, 4000).select(F.col("id").alias("query_id"), F.lit("a").alias("item_id"))
    photos = spark.range(0, 2000).select(F.lit("a").alias("item_id"), F.concat(F.lit("/data/p"), "id").alias("image_uri"))
    J.references_by_item(ids, photos)[0].write.parquet(f"{tmp_path}/found")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.25 * 4000 * 2000
    found = spark.read.parquet(f"{tmp_path}/found")
    assert found.distinct().count() == found.count() == 4000 * 2000
