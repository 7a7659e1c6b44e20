"""Views over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmatch.workload.base import Tables, view


def _model() -> Column:
    return F.when(F.col("label") < 7, "visual-a").otherwise("visual-b")


@view("""
SELECT vec_id AS id, CAST(label AS VARCHAR) AS item_id, 'item-' || label AS slug,
  CASE WHEN label < 7 THEN 'visual-a' ELSE 'visual-b' END AS model_name,
  '/data/reference/catalog/' || label || '/' || CASE WHEN vec_id % 3 = 0 THEN 'web-' ELSE 'dataset-' END || vec_id || '.jpg' AS image_uri,
  CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings
""")
def refs(t: Tables):
    kind = F.when(F.col("vec_id") % 3 == 0, "web-").otherwise("dataset-")
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("item_id"),
        F.concat(F.lit("item-"), "label").alias("slug"), _model().alias("model_name"),
        F.concat(F.lit("/data/reference/catalog/"), "label", F.lit("/"), kind, "vec_id", F.lit(".jpg")).alias("image_uri"),
        "embedding",
    )


@view("""
SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS expected,
  CASE WHEN label < 7 THEN 'visual-a' ELSE 'visual-b' END AS model_name,
  list_transform(embedding, lambda x, i: CAST(CAST(CAST(x AS DOUBLE) + CAST(embedding[(i + 31) % len(embedding) + 1] AS DOUBLE) * 0.9 AS FLOAT) AS DOUBLE)) AS embedding
FROM embeddings
""")
def photo_queries(t: Tables):
    """Every vector overlaid with itself turned by 32 components, as a damaged photo of its item."""
    turned = lambda i: F.element_at("embedding", (i + 32) % F.size("embedding") + 1).cast("double")
    damaged = F.transform("embedding", lambda x, i: (x.cast("double") + turned(i) * 0.9).cast("float"))
    return t.embeddings.select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("expected"), _model().alias("model_name"),
        damaged.alias("embedding"),
    )


@view("""
SELECT vec_id AS id, 'slug-' || (vec_id // 4) AS slug, 'text-a' AS model_name, CAST(embedding AS DOUBLE[]) AS embedding
FROM embeddings
""")
def passages(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("slug-"), F.floor(F.col("vec_id") / 4)).alias("slug"),
        F.lit("text-a").alias("model_name"), "embedding",
    )


@view("""
SELECT vec_id AS query_id, 'text-a' AS model_name,
  list_transform(embedding, lambda x, i: CAST(CAST(CAST(x AS DOUBLE) + CAST(embedding[(i + 31) % len(embedding) + 1] AS DOUBLE) * 0.9 AS FLOAT) AS DOUBLE)) AS embedding
FROM embeddings
""")
def text_queries(t: Tables):
    return t.photo_queries.select("query_id", F.lit("text-a").alias("model_name"), "embedding")


@view("""
SELECT p_partkey AS id, p_name || CASE WHEN p_size > 10 THEN ' ' || (1980 + p_size) ELSE '' END AS name,
  p_type AS category, split_part(p_name, ' ', 1) AS color, ' ' AS region, CAST(NULL AS VARCHAR) AS grape_variety,
  ' Size ' || p_size || ' ' AS description, p_brand AS winery,
  replace(p_name || CASE WHEN p_size > 10 THEN ' ' || (1980 + p_size) ELSE '' END, ' ', '-') AS slug,
  replace(p_name, ' ', '_') || '.png' AS dataset_photo,
  CASE WHEN p_size % 3 = 0 THEN p_partkey || '.jpg' WHEN p_size % 7 = 0 THEN 'old/' || p_partkey || '.jpg' END AS web_photo,
  p_size, p_retailprice
FROM part
""")
def catalog(t: Tables):
    size = F.col("p_size")
    name = F.concat("p_name", F.when(size > 10, F.concat(F.lit(" "), (size + 1980).cast("string"))).otherwise(F.lit("")))
    return t.part.select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_type").alias("category"),
        F.split("p_name", " ")[0].alias("color"), F.lit(" ").alias("region"), F.lit(None).cast("string").alias("grape_variety"),
        F.concat(F.lit(" Size "), size, F.lit(" ")).alias("description"), F.col("p_brand").alias("winery"),
        F.replace(name, F.lit(" "), F.lit("-")).alias("slug"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".png")).alias("dataset_photo"),
        F.when(size % 3 == 0, F.concat("p_partkey", F.lit(".jpg"))).when(
            size % 7 == 0, F.concat(F.lit("old/"), "p_partkey", F.lit(".jpg"))).alias("web_photo"),
        "p_size", "p_retailprice",
    )


@view("""
SELECT c.slug, arg_min(c.name, k) AS name, arg_min(c.winery, k) AS winery, arg_min(c.web_photo, k) AS web_photo,
  min(c.id) AS id, arg_min(c.id, k) AS card_id,
  CASE WHEN arg_min(c.p_size, k) > 10 THEN 1980 + arg_min(c.p_size, k) END AS vintage
FROM (SELECT *, id + CASE WHEN web_photo IS NULL THEN 1000000000000 ELSE 0 END AS k FROM catalog) c GROUP BY c.slug
""")
def cards(t: Tables):
    from shelfmatch.operators.validate import explicit_vintage
    from shelfmatch.operators.windows import one_card_per_slug

    one = one_card_per_slug(t.catalog)
    return one.select(
        "slug", "name", "winery", "web_photo", F.col("id").alias("card_id"),
        explicit_vintage(F.col("name"), F.col("slug")).alias("vintage"),
    )


@view("""
SELECT l_orderkey AS query_id, CAST(l_partkey AS VARCHAR) AS item_id, c.slug, 1 - l_tax * 4 AS image,
  l_quantity / 50 AS geometry, l_discount * 10 AS text, l_returnflag AS flag, l_linestatus AS status,
  CASE WHEN l_tax = 0 AND l_linestatus = 'F' THEN '/data/reference/feedback/' ELSE '/data/reference/catalog/' END
    || l_partkey || '.png' AS uri
FROM lineitem JOIN catalog c ON c.id = l_partkey
""")
def branch_lines(t: Tables):
    """Order lines as candidates: 'N' lines only come from text, 'R' lines only from the photo."""
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey"), (F.lit(1) - F.col("l_tax") * 4).alias("image"),
        (F.col("l_quantity") / 50).alias("geometry"), (F.col("l_discount") * 10).alias("text"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_tax"),
    )
    folder = F.when((F.col("l_tax") == 0) & (F.col("status") == "F"), "/data/reference/feedback/").otherwise(
        "/data/reference/catalog/")
    return lines.join(t.catalog.select(F.col("id").alias("l_partkey"), "slug"), "l_partkey").select(
        "query_id", F.col("l_partkey").cast("string").alias("item_id"), "slug", "image", "geometry", "text", "flag", "status",
        F.concat(folder, "l_partkey", F.lit(".png")).alias("uri"),
    )


@view("""
SELECT * FROM (
  SELECT query_id, slug, max(image) AS score, min(item_id) AS item_id, max(uri) AS best_image_uri, 'visual-a' AS model_name,
    row_number() OVER (PARTITION BY query_id ORDER BY max(image) DESC, slug) AS src_order
  FROM branch_lines WHERE flag <> 'N' GROUP BY query_id, slug) WHERE src_order <= 20
""")
def shortlist(t: Tables):
    from shelfmatch.skew import top_per_key

    best = t.branch_lines.where("flag <> 'N'").groupBy("query_id", "slug").agg(
        F.max("image").alias("score"), F.min("item_id").alias("item_id"), F.max("uri").alias("best_image_uri"),
    ).withColumn("model_name", F.lit("visual-a"))
    return top_per_key(best, ["query_id"], [F.desc("score"), F.col("slug")], 20, "src_order")


@view("""
SELECT query_id, slug, score FROM (
  SELECT query_id, slug, max(geometry) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY max(geometry) DESC, slug) AS rn
  FROM branch_lines WHERE flag <> 'A' OR status = 'F' GROUP BY query_id, slug) WHERE rn <= 10
""")
def visual_scores(t: Tables):
    from shelfmatch.operators.ranking import top_scores

    rows = t.branch_lines.where("flag <> 'A' or status = 'F'").select("query_id", "slug", F.col("geometry").alias("score"))
    return top_scores(rows, key="slug").drop("rank")


@view("""
SELECT query_id, slug, score FROM (
  SELECT query_id, slug, max(text) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY max(text) DESC, slug) AS rn
  FROM branch_lines WHERE flag <> 'R' GROUP BY query_id, slug) WHERE rn <= 10
""")
def text_scores(t: Tables):
    from shelfmatch.operators.ranking import top_scores

    rows = t.branch_lines.where("flag <> 'R'").select("query_id", "slug", F.col("text").alias("score"))
    return top_scores(rows, key="slug").drop("rank")


@view("""
SELECT o_orderkey AS query_id,
  'Wine ' || o_orderpriority || ' ' || c_mktsegment || CASE WHEN o_orderstatus = 'F' THEN ' Straße' ELSE '' END AS text,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_custkey % 100) / 100.0 + 0.2 END AS text_confidence,
  CASE WHEN o_orderstatus = 'F' THEN [CAST(year(o_orderdate) AS INTEGER)]
       WHEN o_orderstatus = 'O' THEN [CAST(year(o_orderdate) AS INTEGER), 1991] ELSE [] END AS years
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def evidence(t: Tables):
    status, year = F.col("o_orderstatus"), F.year("o_orderdate")
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return t.orders.join(people, "o_custkey").select(
        F.col("o_orderkey").alias("query_id"),
        F.concat(F.lit("Wine "), "o_orderpriority", F.lit(" "), "c_mktsegment",
                 F.when(status == "F", " Straße").otherwise("")).alias("text"),
        F.when(status != "P", (F.col("o_custkey") % 100) / 100.0 + 0.2).alias("text_confidence"),
        F.when(status == "F", F.array(year)).when(status == "O", F.array(year, F.lit(1991))).otherwise(
            F.array().cast("array<int>")).alias("years"),
    )


@view("""
SELECT CAST(event_id AS VARCHAR) AS job_id, sha256(CAST(user_id AS VARCHAR)) AS image_sha256, 'slug-1' AS predicted_slug,
  event_type IN ('view', 'click') AS is_correct,
  CASE WHEN event_type = 'purchase' THEN NULL ELSE 'slug-' || CAST(floor(value) AS BIGINT) % 3 END AS correct_slug,
  CASE WHEN event_type = 'view' THEN 'approved' WHEN event_type = 'error' THEN 'rejected' ELSE 'pending' END AS review_status,
  CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'indexing'
    ELSE 'unlabeled' END AS embedding_state,
  CASE WHEN event_type = 'view' THEN '/data/reference/feedback/' || user_id || '/' || event_id % 5 || '.png' END AS reference_uri,
  CAST(event_id % 4 AS INTEGER) AS label_revision, epoch_us(ts) AS updated_us, user_id
FROM events
""")
def feedback(t: Tables):
    kind, n = F.col("event_type"), F.floor("value") % 3
    state = F.when(kind == "view", "ready").when(kind == "click", "queued").when(kind == "error", "failed").when(
        kind == "signup", "indexing").otherwise("unlabeled")
    return t.events.select(
        F.col("event_id").cast("string").alias("job_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("image_sha256"),
        F.lit("slug-1").alias("predicted_slug"), kind.isin("view", "click").alias("is_correct"),
        F.when(kind != "purchase", F.concat(F.lit("slug-"), n.cast("string"))).alias("correct_slug"),
        F.when(kind == "view", "approved").when(kind == "error", "rejected").otherwise("pending").alias("review_status"),
        state.alias("embedding_state"), F.lit(None).cast("string").alias("embedding_error"),
        F.when(kind == "view", F.concat(
            F.lit("/data/reference/feedback/"), "user_id", F.lit("/"), F.col("event_id") % 5, F.lit(".png"))).alias("reference_uri"),
        F.when(kind == "view", F.concat(F.lit("slug-"), n.cast("string"))).alias("indexed_slug"),
        (F.col("event_id") % 4).cast("int").alias("label_revision"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.unix_micros("ts").alias("updated_us"), "user_id",
    )


@view("""
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, sha256(CAST(user_id AS VARCHAR)) AS image_sha256,
  'slug-1' AS predicted_slug, event_type IN ('view', 'click') AS is_correct,
  CASE WHEN event_type = 'purchase' THEN NULL ELSE 'slug-' || CAST(floor(value) AS BIGINT) % 3 END AS correct_slug
FROM events
""")
def votes(t: Tables):
    """Every event as a vote of its user; ids give the order."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("image_sha256"), F.lit("slug-1").alias("predicted_slug"),
        kind.isin("view", "click").alias("is_correct"),
        F.when(kind != "purchase", F.concat(F.lit("slug-"), (F.floor("value") % 3).cast("string"))).alias("correct_slug"), "ts",
    )


@view("""
SELECT conv_id AS image_id, turn AS pos, role AS variant, text,
  trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS normalized_text,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE ((conv_id * 7 + turn * 13) % 101) / 100.0 END AS confidence
FROM conversations
""")
def turns(t: Tables):
    from shelfmatch.functions.text import normalize_text

    return t.conversations.select(
        F.col("conv_id").alias("image_id"), F.col("turn").alias("pos"), F.col("role").alias("variant"), "text",
        normalize_text(F.col("text")).alias("normalized_text"),
        F.when(F.col("turn") % 5 != 4, ((F.col("conv_id") * 7 + F.col("turn") * 13) % 101) / 100.0).alias("confidence"),
    )


@view("""
SELECT l_orderkey AS image_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS pos,
  CASE WHEN l_returnflag = 'A' THEN 'central_crop' ELSE 'full' END AS variant,
  p_name || CASE WHEN p_size > 40 THEN ' ' || (1970 + p_size) ELSE '' END AS text,
  p_name || CASE WHEN p_size > 40 THEN ' ' || (1970 + p_size) ELSE '' END AS normalized_text,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE round(1 - l_discount * 4, 2) END AS confidence,
  CASE WHEN l_tax = 0.07 THEN NULL ELSE (l_suppkey % 3) * 130.0 END AS min_x,
  CASE WHEN l_tax = 0.07 THEN NULL ELSE (l_linenumber % 4) * 40.0 END AS min_y,
  CASE WHEN l_tax = 0.07 THEN NULL ELSE (l_suppkey % 3) * 130.0 + 100 + (l_partkey % 3) * 10 END AS max_x,
  CASE WHEN l_tax = 0.07 THEN NULL ELSE (l_linenumber % 4) * 40.0 + 30 + (l_linenumber % 2) * 4 END AS max_y
FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def label_blocks(t: Tables):
    """Order lines as recognised text blocks of one label per order."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    x = (F.col("l_suppkey") % 3) * 130.0
    y = (F.col("l_linenumber") % 4) * 40.0
    box = F.struct(
        x.alias("min_x"), y.alias("min_y"), (x + 100 + (F.col("l_partkey") % 3) * 10).alias("max_x"),
        (y + 30 + (F.col("l_linenumber") % 2) * 4).alias("max_y"),
    )
    text = F.concat("p_name", F.when(F.col("p_size") > 40, F.concat(F.lit(" "), F.col("p_size") + 1970)).otherwise(F.lit("")))
    pos = F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    return t.lineitem.join(part, "l_partkey").select(
        F.col("l_orderkey").alias("image_id"), pos.alias("pos"), pos.alias("seq"),
        F.when(F.col("l_returnflag") == "A", "central_crop").otherwise("full").alias("variant"), text.alias("text"),
        text.alias("normalized_text"), F.when(F.col("l_tax") != 0.08, F.round(1 - F.col("l_discount") * 4, 2)).alias("confidence"),
        F.when(F.col("l_tax") != 0.07, box).alias("box"),
    )


@view("""
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, v.variant,
  p_name AS t_text, p_name AS t_name, p_brand AS t_producer, CAST(1980 + p_size AS VARCHAR) AS t_year,
  CASE v.variant WHEN 'A' THEN upper(p_name) WHEN 'B' THEN replace(p_name, 'e', 'c') WHEN 'C' THEN p_name || ' ' || p_type
    WHEN 'D' THEN replace(p_name, ' ', '') ELSE reverse(p_name) END AS text,
  CASE v.variant WHEN 'B' THEN replace(p_name, 'e', 'c') WHEN 'E' THEN reverse(p_name) ELSE p_name END AS name,
  CASE WHEN p_size % 5 = 0 AND v.variant = 'C' THEN '' ELSE p_brand END AS producer,
  CASE WHEN p_size % 4 = 0 AND v.variant IN ('B', 'D') THEN '' ELSE CAST(1980 + p_size AS VARCHAR) END AS year,
  1 + (p_partkey * 7 + ascii(v.variant) * p_size) % 9 AS rank,
  CASE WHEN p_size % 10 = 0 AND v.variant = 'E' THEN 'not_run' WHEN p_size % 11 = 0 AND v.variant = 'C' THEN 'failed' ELSE 'ok' END AS status,
  p_type AS condition
FROM part, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(variant)
""")
def variant_rows(t: Tables):
    """Five image variants of every catalog row, with damaged readings."""
    name, size = F.col("p_name"), F.col("p_size")
    year = (size + 1980).cast("string")
    v = F.col("variant")
    rows = t.part.withColumn("variant", F.explode(F.array(*[F.lit(c) for c in "ABCDE"])))
    text = (
        F.when(v == "A", F.upper(name)).when(v == "B", F.replace(name, F.lit("e"), F.lit("c")))
        .when(v == "C", F.concat_ws(" ", name, "p_type")).when(v == "D", F.replace(name, F.lit(" "), F.lit("")))
        .otherwise(F.reverse(name))
    )
    read = F.when(v == "B", F.replace(name, F.lit("e"), F.lit("c"))).when(v == "E", F.reverse(name)).otherwise(name)
    return rows.select(
        F.col("p_partkey").cast("string").alias("sample_id"), "variant",
        F.struct(name.alias("full_text"), name.alias("name"), F.col("p_brand").alias("producer"), year.alias("year")).alias("truth"),
        F.struct(
            text.alias("full_text"), read.alias("name"),
            F.when((size % 5 == 0) & (v == "C"), "").otherwise(F.col("p_brand")).alias("producer"),
            F.when((size % 4 == 0) & v.isin("B", "D"), "").otherwise(year).alias("year"),
        ).alias("prediction"),
        (F.lit(1) + (F.col("p_partkey") * 7 + F.ascii(v) * size) % 9).alias("rank"),
        F.when((size % 10 == 0) & (v == "E"), "not_run").when((size % 11 == 0) & (v == "C"), "failed").otherwise("ok").alias("status"),
        F.array("p_type").alias("conditions"),
    )
