"""Vector search, top-k and retrieval-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmatch.functions import vectors as N
from shelfmatch.operators import aggregates as A
from shelfmatch.operators import joins as J
from shelfmatch.operators import knn
from shelfmatch.operators import ranking as R
from shelfmatch.operators import sets as U
from shelfmatch.operators import validate as V
from shelfmatch.operators import windows as W
from shelfmatch.plans import retrieval as P
from shelfmatch.workload.base import Tables, query, rounded

# Distances within a query's model, with equal distances made equal as in the operator.
DISTANCES = """
d AS (SELECT q.query_id, q.expected, r.item_id, r.slug, r.image_uri,
        round(1 - list_cosine_similarity(q.embedding, r.embedding), 12) AS distance
      FROM photo_queries q JOIN refs r USING (model_name)),
best AS (SELECT query_id, expected, item_id, min(slug) AS slug, min(distance) AS distance, arg_min(image_uri, (distance, image_uri)) AS image_uri
      FROM d GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM best)
"""
TEXT_DISTANCES = """
d AS (SELECT q.query_id, p.id, p.slug, round(1 - list_cosine_similarity(q.embedding, p.embedding), 12) AS distance
      FROM text_queries q JOIN passages p USING (model_name)),
best AS (SELECT query_id, slug, min(distance) AS distance, arg_min(id, (distance, id)) AS id FROM d GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM best)
"""


def _with(extra: str, select: str) -> str:
    return f"SELECT * FROM (WITH {extra.strip()} {select})"


VECTORS = ["refs", "photo_queries"]
TEXTS = ["passages", "text_queries"]


@query(_with(DISTANCES, """
SELECT query_id, image_uri, item_id, rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_uri) AS rank FROM d) WHERE rank <= 10
"""), VECTORS)
def knn_join(t: Tables):
    return rounded(knn.knn_join(t.photo_queries, t.refs, 10).select("query_id", "image_uri", "item_id", "rank", "distance"))


@query(_with(TEXT_DISTANCES, """
SELECT query_id, id, slug, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 10
"""), TEXTS)
def knn_distinct_items(t: Tables):
    return rounded(knn.knn_distinct_items(t.text_queries, t.passages, 10).select("query_id", "id", "slug", "rank", "distance"))


@query(_with(DISTANCES, """
SELECT query_id, rank, item_id, slug, image_uri AS best_image_uri, round(distance, 6) AS distance, round(1 - distance, 6) AS score
FROM ranked WHERE rank <= 5
"""), VECTORS)
def search_items(t: Tables):
    return rounded(P.search_items(t.photo_queries, t.refs, 5))


@query(_with(TEXT_DISTANCES, """
SELECT query_id, rank, id, slug, round(distance, 6) AS distance, round(greatest(0, least(1, 1 - distance / 2)), 6) AS score
FROM ranked WHERE rank <= 10
"""), TEXTS)
def match_text(t: Tables):
    return rounded(P.match_text(t.text_queries, t.passages))


def _items(t: Tables) -> int:
    """How many items there are, so that a search for so many leaves none out."""
    return max(1, t.refs.select("item_id").distinct().count())


@query(_with(DISTANCES, """
SELECT query_id, item_id, image_uri, round(distance, 6) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY distance, image_uri) = 1
"""), VECTORS)
def best_per_item(t: Tables):
    """The closest photo of every item, over all items."""
    near = knn.knn_items(t.photo_queries, t.refs, _items(t)).select("query_id", "item_id", "image_uri", "distance")
    return rounded(R.best_per_item(near))


@query(_with(DISTANCES, """
SELECT query_id, item_id, rank, round(1 - distance, 6) AS score FROM ranked WHERE rank <= 3
"""), VECTORS)
def top_items(t: Tables):
    near = knn.knn_items(t.photo_queries, t.refs, 10).drop("rank")
    return rounded(R.top_items(near, 3).select("query_id", "item_id", "rank", "score"))


@query(_with(DISTANCES, """
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY m, item_id) AS rank FROM (
  SELECT query_id, item_id, min(distance) AS m FROM d GROUP BY ALL) QUALIFY rank <= 3
"""), VECTORS)
def distinct_top_k(t: Tables):
    near = knn.knn_items(t.photo_queries, t.refs, _items(t)).select("query_id", "item_id", "image_uri", "distance")
    return R.distinct_top_k(near, 3).select("query_id", "item_id", "rank")


@query(_with(DISTANCES, """
SELECT q.query_id, q.expected, r.rank FROM photo_queries q
LEFT JOIN ranked r ON r.query_id = q.query_id AND r.item_id = q.expected AND r.rank <= 3
"""), VECTORS)
def rank_of_expected(t: Tables):
    return R.rank_of_expected(P.search_items(t.photo_queries, t.refs, 3), t.photo_queries)


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding FROM (SELECT query_id AS vec_id, embedding FROM text_queries)),
d AS (SELECT q.query_id, p.id, round(1 - list_cosine_similarity(q.embedding, p.embedding), 12) AS distance FROM q, passages p)
SELECT query_id, query_id AS expected, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE id = query_id
""".replace("WITH q AS", "SELECT * FROM (WITH q AS", 1) + ")", TEXTS)
def gallery_rank(t: Tables):
    asked = t.text_queries.withColumn("expected", F.col("query_id"))
    return knn.gallery_rank(asked, t.passages, item="id")[0]


@query(_with(DISTANCES, """
SELECT k.k, count(*) FILTER (r.rank <= k.k) AS correct, round(count(*) FILTER (r.rank <= k.k) / count(*), 4) AS recall
FROM ranked r, (VALUES (1), (3), (5), (20)) k(k) WHERE r.item_id = r.expected GROUP BY k.k
"""), VECTORS, big=["k"])
def recall_at_k(t: Tables):
    return P.recall_report(t.photo_queries, t.refs, 3)


@query(_with(DISTANCES, """
SELECT 'ok' AS status, count(*) AS queries_total, count(*) AS queries_processed, 0 AS queries_with_errors,
  count(*) FILTER (rank <= 3) AS correct_queries, round(count(*) FILTER (rank <= 3) / count(*), 4) AS recall_at_k, 3 AS top_k
FROM ranked WHERE item_id = expected
"""), VECTORS, big=["queries_with_errors", "top_k"])
def evaluation_report(t: Tables):
    return P.evaluate_retrieval(t.photo_queries, t.refs, 3)["report"]


@query(_with(DISTANCES, """
SELECT e.query_id, e.expected, e.rank AS expected_rank, p.predicted FROM ranked e
JOIN (SELECT query_id, string_agg(item_id, ',' ORDER BY rank) AS predicted FROM ranked WHERE rank <= 2 GROUP BY 1) p USING (query_id)
WHERE e.item_id = e.expected AND e.rank > 2
"""), VECTORS)
def evaluate_retrieval(t: Tables):
    misses = P.evaluate_retrieval(t.photo_queries, t.refs, 2)["misses"]
    return misses.withColumn("predicted", F.array_join("predicted", ","))


@query("""
SELECT query_id, expected, model_name, 'item_not_indexed' AS error_type FROM
  (SELECT query_id, CASE WHEN query_id % 10 = 0 THEN 'item-' || expected ELSE expected END AS expected, model_name FROM photo_queries) q
WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.item_id = q.expected AND r.model_name = q.model_name)
""", VECTORS)
def eval_queries_vs_index(t: Tables):
    strange = F.when(F.col("query_id") % 10 == 0, F.concat(F.lit("item-"), "expected")).otherwise(F.col("expected"))
    labelled = t.photo_queries.select("query_id", strange.alias("expected"), "model_name")
    return J.eval_queries_vs_index(labelled, t.refs)[1]


@query(_with(DISTANCES, "SELECT query_id, string_agg(item_id, ',' ORDER BY rank) AS ids FROM ranked GROUP BY 1"), VECTORS)
def top_ids(t: Tables):
    """All items of a query's model, the nearest first."""
    ranked = P.search_items(t.photo_queries, t.refs, _items(t))
    return R.top_ids(ranked, None).withColumn("ids", F.array_join("ids", ","))


@query(_with(DISTANCES, """
SELECT query_id, round(max(1 - distance) FILTER (rank = 1), 6) AS top_score, round(max(1 - distance) FILTER (rank = 2), 6) AS next_score,
  round(max(1 - distance) FILTER (rank = 1) - max(1 - distance) FILTER (rank = 2), 6) AS margin
FROM ranked GROUP BY 1
"""), VECTORS)
def score_margin(t: Tables):
    return rounded(R.score_margin(P.search_items(t.photo_queries, t.refs, 2)))


@query("""
SELECT item_id, min(slug) OVER (PARTITION BY item_id) AS slug, image_uri FROM refs WHERE model_name = 'visual-a'
""", ["refs"])
def list_items(t: Tables):
    return A.list_items(t.refs, "visual-a")


@query("SELECT model_name, count(*) AS photos, count(DISTINCT item_id) AS items FROM refs GROUP BY 1", ["refs"])
def reference_counts(t: Tables):
    return A.reference_counts(t.refs)


@query("""
SELECT item_id, min(slug) AS slug, count(*) AS photos FROM refs WHERE model_name = 'visual-a' GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 2
""", ["refs"])
def page_items(t: Tables):
    return R.page_items(t.refs, "visual-a", 3, 2)


@query("""
SELECT model_name, slug, arg_min(image_uri, CASE WHEN image_uri LIKE '%/web-%' THEN id ELSE id + 1000000000 END) AS image_uri
FROM refs GROUP BY ALL
""", ["refs"])
def canonical_reference(t: Tables):
    return W.canonical_reference(t.refs).select("model_name", "slug", "image_uri")


@query("SELECT id, slug, min(id) OVER (PARTITION BY slug) AS canonical_id FROM refs", ["refs"])
def canonical_id(t: Tables):
    return W.canonical_id(t.refs.select("id", "slug"))


@query("""
SELECT count(*) AS reference_images, count(*) FILTER (model_name = 'visual-a') AS model_reference_images,
  min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension, 'ok' AS status FROM refs
""", ["refs"])
def index_health(t: Tables):
    return V.index_health(t.refs, "visual-a", 64)


@query("""
SELECT DISTINCT 'image' AS kind, model_name, len(embedding) AS dimension FROM refs
UNION SELECT DISTINCT 'text', model_name, len(embedding) FROM passages
""", ["refs", "passages"])
def model_inventory(t: Tables):
    texts = t.passages.select(
        F.col("embedding").alias("description_text_embedding"), F.col("model_name").alias("description_text_embedding_model"))
    return A.model_inventory(t.refs, texts)


@query("""
SELECT id AS vec_id, CASE WHEN model_name <> 'visual-a' THEN 'unexpected_model' WHEN len(embedding) <> 64 THEN 'unexpected_dimension' END AS problem
FROM refs
""", ["refs"])
def validate_vectors(t: Tables):
    return V.validate_vectors(t.refs, 64, "visual-a").select(F.col("id").alias("vec_id"), "problem")


@query("""
SELECT r.id, round(1 - list_cosine_similarity(r.embedding, q.embedding), 6) AS distance FROM refs r JOIN photo_queries q ON q.query_id = r.id
""", VECTORS)
def cosine_distance(t: Tables):
    damaged = t.photo_queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("damaged"))
    return rounded(t.refs.join(damaged, "id").select("id", N.cosine_distance(F.col("embedding"), F.col("damaged")).alias("distance")))


@query("""
SELECT id, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS x FROM (
  SELECT id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u FROM refs)
""", ["refs"])
def l2_normalize(t: Tables):
    unit = t.refs.select("id", N.l2_normalize(F.col("embedding")).alias("u"))
    return rounded(unit.select("id", F.posexplode("u").alias("pos", "x")))


@query("""
WITH s AS (SELECT label AS id, pos, sum(x * (vec_id % 5 + 1)) AS x FROM (
    SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)
SELECT id, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM s
""", big=["id"])
def weighted_pool(t: Tables):
    chunks = t.embeddings.select(F.col("label").alias("id"), (F.col("vec_id") % 5 + 1).alias("weight"), "embedding")
    out = knn.pooled(chunks)
    return rounded(out.select("id", F.posexplode("embedding").alias("pos", "x")))


@query("SELECT vec_id, round(greatest(0, least(1, 1 - (label / 4.0) / 2)), 6) AS score, label / 4.0 BETWEEN -0.000001 AND 2.000001 AS valid FROM embeddings".replace(
    "round(greatest(0, least(1, 1 - (label / 4.0) / 2)), 6) AS score", "CASE WHEN label / 4.0 <= 2.000001 THEN round(greatest(0, least(1, 1 - (label / 4.0) / 2)), 6) END AS score"))
def rescale_similarity(t: Tables):
    distance = F.col("label") / 4.0
    return rounded(t.embeddings.select(
        "vec_id", N.rescale_similarity(distance).alias("score"), distance.between(-1e-6, 2 + 1e-6).alias("valid")))


@query("""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.h, b.h), lambda z: least(z[1], z[2]))), 6) AS similarity
FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: abs(x) / 8) AS h FROM embeddings) a
JOIN (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[33:64], lambda x: abs(x) / 8) AS h FROM embeddings) b USING (vec_id)
""")
def histogram_similarity(t: Tables):
    part = lambda begin: F.transform(F.slice("embedding", begin, 32), lambda x: F.abs(x.cast("double")) / 8)
    return rounded(t.embeddings.select("vec_id", N.histogram_similarity(part(1), part(33)).alias("similarity")))


@query("""
SELECT min(n) AS item_count, min(d) AS dimension, max(d) AS max_dimension, sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY i)) AS sha256 FROM (
  SELECT i, count(*) AS n, min(dim) AS d, sum(CAST('0x' || substr(h, 1 + 8 * CAST(i AS INT), 8) AS HUGEINT)) AS s FROM (
    SELECT len(embedding) AS dim, sha256(vec_id || '|' || array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000000) AS BIGINT)), ',')) AS h
    FROM embeddings), range(8) r(i) GROUP BY i)
""")
def gallery_fingerprint(t: Tables):
    return A.gallery_fingerprint(t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding"))


@query("""
SELECT q.query_id, q.item_id, r.image_uri FROM
  (SELECT vec_id AS query_id, CAST((vec_id * 3) % 14 AS VARCHAR) AS item_id FROM embeddings) q LEFT JOIN
  refs r USING (item_id)
""", ["refs"])
def references_by_item(t: Tables):
    """Every query asks for one item; all its photos, or nothing for an unknown item."""
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), ((F.col("vec_id") * 3) % 14).cast("string").alias("item_id"))
    found, missing = J.references_by_item(asked, t.refs)
    return found.select("query_id", "item_id", "image_uri").unionByName(
        missing.select("query_id", "item_id", F.lit(None).cast("string").alias("image_uri")))


@query("""
SELECT id, image_uri FROM refs WHERE model_name = 'visual-b' AND image_uri NOT IN (SELECT image_uri FROM refs WHERE image_uri LIKE '%/web-%')
""", ["refs"])
def prune_candidates(t: Tables):
    keep = t.refs.where(F.col("image_uri").contains("/web-")).select("image_uri")
    return J.prune_candidates(t.refs, keep, "visual-b").select("id", "image_uri")


@query("""
SELECT id, image_uri FROM refs WHERE image_uri LIKE '/data/reference/catalog/%'
""", ["refs"])
def catalog_scope_filter(t: Tables):
    return V.catalog_scope_filter(t.refs).select("id", "image_uri")


@query("""
SELECT CAST(vec_id AS VARCHAR) AS item_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
""")
def unknown_ids(t: Tables):
    ids = t.embeddings.select(F.col("vec_id").cast("string").alias("item_id"))
    return U.unknown_ids(ids, t.labels.select(F.col("doc_id").cast("string").alias("item_id")))
