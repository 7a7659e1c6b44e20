"""Queries over files that Spark writes from the driver's tables and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmatch.session import checkpoint_dir
from shelfmatch.sources import readers, tables
from shelfmatch.workload.base import Tables, query


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}"


def _plain(folder: str) -> str:
    return folder.removeprefix("file:").replace("//", "/")


def _tree(t: Tables) -> str:
    """One text file per size of product, its lines in order of the key."""
    folder = _folder(t)
    lines = t.part.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_size", F.col("p_name").alias("value"))
    lines.write.partitionBy("p_size").text(folder)
    return folder


@query("""
SELECT 'p_size=' || p_size AS folder, strlen(string_agg(p_name, chr(10) ORDER BY p_partkey)) + 1 AS bytes,
  sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10)) AS sha256 FROM part GROUP BY p_size
""")
def file_digests(t: Tables):
    files = tables.file_manifest(t.spark, _plain(_tree(t)))
    return files.where(F.col("file").endswith(".txt")).select(F.substring_index("file", "/", 1).alias("folder"), "bytes", "sha256")


@query("SELECT DISTINCT 'p_size=' || p_size AS item_id, 'p_size=' || p_size AS slug, true AS below FROM part")
def scan_image_tree(t: Tables):
    root = _plain(_tree(t))
    found = readers.scan_image_tree(t.spark, root, [".txt"])
    return found.select("item_id", "slug", F.col("image_uri").startswith(root).alias("below"))


@query("""
SELECT CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 3 THEN 'a/' WHEN 4 THEN 'd' ELSE 's' END || o_orderkey AS sample_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'i' || o_orderkey || '.jpg' END AS image,
  CASE o_orderkey % 5 WHEN 1 THEN 'not a JSON object of this schema' WHEN 2 THEN 'missing image' WHEN 3 THEN 'unsafe name' WHEN 4 THEN 'repeated key' END AS problem
FROM orders, range(2) r(n) WHERE n = 0 OR o_orderkey % 5 = 4
""")
def json_lines(t: Tables):
    """Orders as lines: good ones, cut ones, without a photo, with an unsafe name, and twice."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    line = lambda name, image: F.to_json(F.struct(F.concat(F.lit(name), key).alias("sample_id"), image.alias("image")))
    photo = F.concat(F.lit("i"), key, F.lit(".jpg"))
    value = (
        F.when(kind == 0, line("s", photo)).when(kind == 1, F.concat(F.lit('{"sample_id": "s'), key)).when(kind == 2, line("s", F.lit("")))
        .when(kind == 3, line("a/", photo)).otherwise(line("d", photo))
    )
    folder = _folder(t)
    t.orders.select(F.explode(F.array_repeat(value, F.when(kind == 4, 2).otherwise(1))).alias("value")).write.text(folder)
    good, bad = readers.read_jsonl(t.spark, folder, "sample_id string, image string", ["sample_id", "image"], "sample_id", safe_name=True)
    return good.withColumn("problem", F.lit(None).cast("string")).unionByName(bad.drop("_broken"), allowMissingColumns=True)


@query("SELECT p_name || p_partkey || '.png' AS dataset_photo, 'a,b/\"' || p_partkey || '\".png' AS relative_path FROM part WHERE p_size % 3 = 0")
def matched_manifest(t: Tables):
    """A photo manifest written as CSV with commas and quotes in paths, and its matched rows read again."""
    photo = F.concat("p_name", "p_partkey", F.lit(".png"))
    status = F.when(F.col("p_size") % 3 == 0, "matched").when(F.col("p_size") % 3 == 1, "missing").otherwise("ambiguous")
    path = F.concat(F.lit('a,b/"'), "p_partkey", F.lit('".png'))
    manifest = t.part.select(photo.alias("dataset_photo"), F.when(status == "matched", path).alias("relative_path"), status.alias("status"))
    candidates = manifest.where("status = 'ambiguous'").select("dataset_photo", F.lit("c.png").alias("relative_path"))
    folder = _folder(t)
    tables.write_manifest_csv(manifest, candidates, folder)
    return readers.read_matched_manifest(t.spark, folder)
