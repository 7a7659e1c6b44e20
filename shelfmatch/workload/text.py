"""Text queries over documents, conversations and order labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators import aggregates as A
from shelfmatch.operators import blocks as B
from shelfmatch.operators import joins as J
from shelfmatch.operators import ranking as R
from shelfmatch.operators import windows as W
from shelfmatch.operators.phrases import phrases_in_texts
from shelfmatch.plans import evaluation as E
from shelfmatch.sources import reports
from shelfmatch.workload.base import Tables, query, rounded

# Full case folding of the texts at hand, which hold no other special letters.
FOLD = "replace(lower({}), 'ß', 'ss')"
NORMAL = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORMAL.format('text')}) AS digest, length({NORMAL.format('text')}) AS chars FROM documents")
def normalize_text(t: Tables):
    return t.documents.select("doc_id", X.normalize_text(F.col("text")).alias("n")).select(
        "doc_id", F.md5("n").alias("digest"), F.length("n").alias("chars"))


@query(f"""
SELECT doc_id, len(tokens) AS tokens, md5(array_to_string(tokens, ' ')) AS digest FROM (
  SELECT doc_id, regexp_extract_all({NORMAL.format('text')}, '[0-9]+(?:[.,][0-9]+)?%?|[a-zA-Zа-яА-ЯёЁ]+(?:[-''][a-zA-Zа-яА-ЯёЁ]+)?') AS tokens FROM documents)
""")
def tokenize(t: Tables):
    return t.documents.select("doc_id", X.tokenize(X.normalize_text(F.col("text"))).alias("k")).select(
        "doc_id", F.size("k").alias("tokens"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 4 AND x[1:2] IN ('19', '20')), ',') AS years
FROM documents
""")
def extract_years(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.extract_years(F.col("text")), ",").alias("years"))


@query("""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(text, '%', '%  '), '(?:^|[^0-9])([0-9]{1,2}(?:[.,][0-9]{1,2})?\\s*%)', 1),
  lambda x: replace(regexp_replace(x, '\\s', '', 'g'), ',', '.')), ';') AS percentages FROM documents
""")
def extract_percentages(t: Tables):
    found = F.transform(X.extract_percentages(F.col("text")), lambda p: p["normalized_value"])
    return t.documents.select("doc_id", F.array_join(found, ";").alias("percentages"))


@query("""
SELECT doc_id, array_to_string(list_transform(
  regexp_extract_all(regexp_replace(text, '\\s', '  ', 'g'), '(?:^|[^0-9])((?:0[.,][0-9]{1,3}|[1-9][0-9]{0,3}(?:[.,][0-9]{1,3})?)\\s*(?i:мл|ml|л|l|cl|сl))(?:[^a-zA-Zа-яА-ЯёЁ]|$)', 1),
  lambda x: replace(regexp_extract(x, '^[0-9.,]+'), ',', '.') || ' ' || lower(regexp_extract(x, '[a-zA-Z]+$'))), ';') AS volumes FROM documents
""")
def extract_volumes(t: Tables):
    found = F.transform(X.extract_volumes(F.col("text")), lambda p: p["normalized_value"])
    return t.documents.select("doc_id", F.array_join(found, ";").alias("volumes"))


@query(f"""
SELECT doc_id, len(w) AS words, md5(array_to_string(list_sort(w), ' ')) AS digest FROM (
  SELECT doc_id, list_distinct(regexp_extract_all(replace({FOLD.format('text')}, 'ё', 'е'), '[a-zа-я]{{3,}}')) AS w FROM documents)
""")
def word_set(t: Tables):
    return t.documents.select("doc_id", X.word_set(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("digest"))


@query(f"""
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all({FOLD.format('text')}, '[\\pL\\pN_]+|[^\\pL\\pN_]+'),
  lambda w: CASE WHEN regexp_full_match(w, '[а-яёabcehkmoptxy360]{{3,}}') AND NOT regexp_full_match(w, '[0-9]+')
    THEN translate(w, 'abcehkmoptxy360', 'авсенкмортхузбо') ELSE w END), '')) AS digest FROM documents
""")
def repair_lookalikes(t: Tables):
    return t.documents.select("doc_id", F.md5(X.repair_lookalikes(X.casefold(F.col("text")))).alias("digest"))


@query(f"""
SELECT doc_id, md5({FOLD.format("source || ' ' || text")}) AS digest FROM documents
""".replace(FOLD.format("source || ' ' || text"), "REPAIR(source) || ' ' || REPAIR(text)").replace(
    "REPAIR(source)", "array_to_string(list_transform(regexp_extract_all(replace(lower(source), 'ß', 'ss'), '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda w: CASE WHEN regexp_full_match(w, '[а-яёabcehkmoptxy360]{3,}') AND NOT regexp_full_match(w, '[0-9]+') THEN translate(w, 'abcehkmoptxy360', 'авсенкмортхузбо') ELSE w END), '')").replace(
    "REPAIR(text)", "array_to_string(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda w: CASE WHEN regexp_full_match(w, '[а-яёabcehkmoptxy360]{3,}') AND NOT regexp_full_match(w, '[0-9]+') THEN translate(w, 'abcehkmoptxy360', 'авсенкмортхузбо') ELSE w END), '')"))
def embedding_query_text(t: Tables):
    folded = X.casefold(F.col("text"))
    return t.documents.select("doc_id", F.md5(X.embedding_query_text(folded, X.casefold(F.col("source")))).alias("digest"))


@query("""
SELECT doc_id, c.i AS chunk, len(c.w) AS words, md5(CASE WHEN n <= 128 THEN text ELSE array_to_string(c.w, ' ') END) AS digest FROM (
  SELECT doc_id, text, n, unnest(list_transform(range(0, (n + 127) // 128), lambda i: {'i': i, 'w': words[i * 128 + 1:i * 128 + 128]})) AS c
  FROM (SELECT doc_id, text, words, len(words) AS n FROM (
    SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM documents)))
""")
def chunk_words(t: Tables):
    return t.documents.select("doc_id", F.posexplode(X.chunk_words(F.col("text"), 128)).alias("chunk", "c")).select(
        "doc_id", "chunk", F.size(X.words_of(F.col("c"))).alias("words"), F.md5("c").alias("digest"))


@query(f"""
SELECT doc_id, item_id FROM (WITH c AS MATERIALIZED (
  SELECT d.doc_id, b.item_id, d.n, b.p FROM (SELECT doc_id, {NORMAL.format('text')} AS n FROM documents) d, (
    SELECT item_id, {NORMAL.format('text')} AS p FROM benchmark) b WHERE contains(d.n, b.p))
  SELECT * FROM c WHERE regexp_matches(n, '(^|[^\\pL\\pN_])' || regexp_escape(p) || '($|[^\\pL\\pN_])'))
""")
def contains_phrase(t: Tables):
    """Documents holding a whole benchmark text as a phrase."""
    return phrases_in_texts(
        t.documents.select("doc_id", X.normalize_text(F.col("text")).alias("text")),
        t.benchmark.select("item_id", X.normalize_text(F.col("text")).alias("phrase")))


@query(r"""
SELECT p_partkey, phrase FROM (
  SELECT p_partkey, p_name, unnest(list_distinct(['- ' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || '!', '++', p_name, '& co.', split_part(p_name, ' ', 1) || ' -'])) AS phrase
  FROM part) JOIN (SELECT p_partkey, '++ - ' || p_name || '! & co. ' || p_name || ' - x_' || p_name AS line FROM part) USING (p_partkey)
WHERE regexp_matches(line, '(^|[^\pL\pN_])' || regexp_escape(phrase) || '($|[^\pL\pN_])')
""")
def marked_phrases(t: Tables):
    """Phrases that begin or end with no word character, in lines of product names."""
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    name = F.col("p_name")
    own = F.array_distinct(F.array(
        F.concat(F.lit("- "), first), F.concat(second, F.lit("!")), F.lit("++"), name, F.lit("& co."), F.concat(first, F.lit(" -"))))
    phrases = t.part.select(F.explode(own).alias("phrase")).distinct()
    lines = t.part.select("p_partkey", F.concat(F.lit("++ - "), name, F.lit("! & co. "), name, F.lit(" - x_"), name).alias("text"), own.alias("own"))
    found = phrases_in_texts(lines, phrases.select("phrase", F.col("phrase").alias("same")), "p_partkey", "phrase", "text", "same")
    return found.join(lines.select("p_partkey", "own"), "p_partkey").where(F.array_contains("own", F.col("phrase"))).select("p_partkey", "phrase")


@query("""
SELECT sample_id, variant, levenshtein(lower(t_text), lower(text)) AS distance,
  round(levenshtein(lower(t_text), lower(text)) / length(t_text), 6) AS cer FROM variant_rows
""", ["variant_rows"])
def character_error_rate(t: Tables):
    truth, read = F.col("truth.full_text"), F.col("prediction.full_text")
    return rounded(t.variant_rows.select(
        "sample_id", "variant", X.levenshtein_distance(F.lower(truth), F.lower(read)).alias("distance"),
        X.character_error_rate(truth, read).alias("cer")))


@query("""
SELECT sample_id, variant, t_name = name AS name, t_producer = producer AS producer, t_year = year AS year,
  t_name = name AND t_producer = producer AND t_year = year AS "all" FROM variant_rows
""", ["variant_rows"])
def exact_fields(t: Tables):
    side = lambda s: {f: F.col(f"{s}.{f}") for f in ("name", "producer", "year")}
    return t.variant_rows.select("sample_id", "variant", X.exact_fields(side("truth"), side("prediction")).alias("e")).select(
        "sample_id", "variant", "e.*")


@query(r"SELECT item_id, nullif(regexp_replace('  ' || text || chr(10), '^\s+|\s+$', '', 'g'), '') AS value FROM benchmark")
def clean_value(t: Tables):
    padded = F.concat(F.lit("  "), "text", F.lit("\n"))
    return t.benchmark.select("item_id", X.clean_value(padded).alias("value"))


@query("""
SELECT id, 'Название: ' || name || chr(10) || 'Категория: ' || category || chr(10) || 'Цвет: ' || color || chr(10) || 'Описание: ' || trim(description)
  || chr(10) || 'Винодельня: ' || winery AS passage FROM catalog
""", ["catalog"])
def passage_text(t: Tables):
    from shelfmatch.constants import CATALOG_FIELDS

    return t.catalog.select("id", X.passage_text({f: F.col(f) for f in CATALOG_FIELDS}).alias("passage"))


@query("""
SELECT image_id, pos, CASE WHEN length(regexp_replace(c, '[^\\pL]', '', 'g')) < 3 OR length(c) > 60 THEN '' ELSE c END AS name FROM (
  SELECT image_id, pos, regexp_replace(text, ' (19|20)[0-9][0-9]$', '') AS c FROM label_blocks)
""", ["label_blocks"])
def clean_name(t: Tables):
    return t.label_blocks.select("image_id", "pos", X.clean_name(F.col("text")).alias("name"))


@query("""
SELECT image_id, pos, row_number() OVER (PARTITION BY image_id ORDER BY min_y NULLS LAST, min_x NULLS LAST, normalized_text, pos) AS place FROM label_blocks
""", ["label_blocks"])
def reading_order(t: Tables):
    blocks = t.label_blocks.withColumn("block", F.col("pos")).drop("pos")
    return R.reading_order(blocks).select("image_id", F.col("block").alias("pos"), F.col("pos").alias("place"))


# One list per text of a photo, folded in reading order; e is a kept block, r the next one.
IOU = """
CASE WHEN e.x1 IS NULL OR r.x1 IS NULL THEN 1 WHEN least(e.x2, r.x2) > greatest(e.x1, r.x1) AND least(e.y2, r.y2) > greatest(e.y1, r.y1) THEN
  (least(e.x2, r.x2) - greatest(e.x1, r.x1)) * (least(e.y2, r.y2) - greatest(e.y1, r.y1)) / ((e.x2 - e.x1) * (e.y2 - e.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
    - (least(e.x2, r.x2) - greatest(e.x1, r.x1)) * (least(e.y2, r.y2) - greatest(e.y1, r.y1))) ELSE 0 END
"""


@query(f"""
SELECT image_id, normalized_text, k.pos AS pos, k.c AS confidence FROM (
  SELECT image_id, normalized_text, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda kept, x:
    CASE WHEN NOT list_bool_or(list_transform(kept, lambda e: list_transform(x, lambda r: {IOU} >= 0.6)[1])) THEN list_concat(kept, x)
    ELSE list_transform(kept, lambda e, i: CASE WHEN i = list_position(list_transform(kept, lambda e: list_transform(x, lambda r: {IOU} >= 0.6)[1]), true)
      AND coalesce(x[1].c, -1) > coalesce(e.c, -1) THEN x[1] ELSE e END) END)) AS k
  FROM (SELECT image_id, normalized_text, list(struct_pack(pos := pos, c := confidence, x1 := min_x, y1 := min_y, x2 := max_x, y2 := max_y)
      ORDER BY min_y NULLS LAST, min_x NULLS LAST, pos) AS rows FROM label_blocks GROUP BY ALL))
""", ["label_blocks"])
def duplicate_blocks(t: Tables):
    blocks = t.label_blocks.select("image_id", F.col("pos").alias("block"), "seq", "normalized_text", "confidence", "box")
    kept = B.duplicate_blocks(blocks, order=R.reading_order)
    return kept.select("image_id", "normalized_text", F.col("block").alias("pos"), "confidence")


SIZED = """
SELECT *, greatest(1, max_y - min_y) AS h, max_x - min_x AS w FROM label_blocks WHERE min_x IS NOT NULL
"""
PAIRS = f"""
WITH s AS ({SIZED}), p AS (
  SELECT a.image_id, a.variant, a.pos AS pos_a, b.pos AS pos_b, least(a.h, b.h) AS lo, greatest(a.h, b.h) AS hi,
    least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) AS oy, greatest(a.min_x, b.min_x) - least(a.max_x, b.max_x) AS gx,
    least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) AS ox, least(a.w, b.w) AS nw, greatest(a.w, b.w) AS bw,
    abs((a.min_x + a.max_x - b.min_x - b.max_x) / 2) AS off, least(a.confidence, b.confidence) AS c, a.confidence IS NULL OR b.confidence IS NULL AS nc,
    CASE WHEN a.min_y <= b.min_y THEN b.min_y - a.max_y ELSE a.min_y - b.max_y END AS gy,
    a.min_x < b.min_x AS a_left, a.min_y <= b.min_y AS a_up
  FROM s a JOIN s b ON a.image_id = b.image_id AND a.variant = b.variant AND a.pos < b.pos)
SELECT image_id, variant, pos_a, pos_b, CASE WHEN oy >= lo * 0.4 THEN 'line' ELSE 'stack' END AS layout FROM p
WHERE lo / hi >= 0.6 AND CASE WHEN oy >= lo * 0.4 THEN gx >= 0 AND gx <= hi
  ELSE NOT nc AND c >= 0.75 AND nw / bw >= 0.65 AND off <= nw * 0.25 AND gy BETWEEN -0.25 * hi AND 0.75 * hi AND ox >= nw * 0.4 END
"""


@query(f"SELECT * FROM ({PAIRS})", ["label_blocks"])
def joinable_blocks(t: Tables):
    return J.joinable_blocks(t.label_blocks)


@query(f"""
SELECT image_id, name, round(name_score, 6) AS name_score, block_count FROM (
  WITH plausible AS (
    SELECT *, regexp_replace(text, ' (19|20)[0-9][0-9]$', '') AS value, CASE WHEN min_x IS NULL THEN 1 ELSE greatest(1, max_y - min_y) END AS h
    FROM label_blocks WHERE confidence >= 0.55 AND (min_x IS NULL OR abs((min_x + max_x) / 2 - 200) <= 100)),
  regular AS (SELECT image_id, variant, coalesce(max(h) FILTER (confidence >= 0.7), 0) AS regular FROM plausible GROUP BY ALL),
  eligible0 AS (SELECT p.* FROM plausible p JOIN regular USING (image_id, variant) WHERE confidence >= 0.7 OR (regular > 0 AND h >= regular * 3)),
  eligible AS (SELECT * FROM eligible0 e WHERE variant = (SELECT min(variant) FROM eligible0 x WHERE x.image_id = e.image_id)),
  tallest AS (SELECT image_id, max(h) AS max_h FROM eligible GROUP BY 1),
  pairs AS (SELECT j.*, a.value AS va, b.value AS vb, a.confidence AS ca, b.confidence AS cb, least(a.h, b.h) AS h,
      least(a.min_x, b.min_x) AS x1, greatest(a.max_x, b.max_x) AS x2,
      CASE WHEN layout = 'line' THEN a.min_x <= b.min_x ELSE a.min_y <= b.min_y END AS a_first
    FROM ({PAIRS}) j JOIN eligible a ON a.image_id = j.image_id AND a.pos = j.pos_a AND a.confidence >= 0.75
      JOIN eligible b ON b.image_id = j.image_id AND b.pos = j.pos_b AND b.confidence >= 0.75),
  options AS (
    SELECT image_id, value AS name, confidence, h, (min_x + max_x) / 2 AS cx, 1 AS block_count, pos AS pos_a, -1 AS pos_b FROM eligible
    UNION ALL SELECT image_id, CASE WHEN a_first THEN va || ' ' || vb ELSE vb || ' ' || va END, least(ca, cb), h, (x1 + x2) / 2, 2, pos_a, pos_b FROM pairs),
  scored AS (SELECT *, 1.5 * least(h / max_h, 1) + 1.5 * CASE WHEN cx IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(cx - 200) / 200) END
      + 1.5 * confidence + 0.8 * least(length(regexp_replace(name, '[^\\pL]', '', 'g')) / 20, 1) + CASE WHEN block_count = 2 THEN 0.8 ELSE 0 END AS name_score
    FROM options JOIN tallest USING (image_id))
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY name_score DESC, block_count, pos_a, pos_b) AS rn FROM scored) WHERE rn = 1
""", ["label_blocks"], big=["block_count"])
def candidate_name(t: Tables):
    images = t.lineitem.select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("width", F.lit(400))
    return rounded(B.candidate_name(t.label_blocks, images).select("image_id", "name", "name_score", "block_count"))


@query("""
SELECT image_id, field_type, normalized_value, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, field_type, normalized_value ORDER BY coalesce(confidence, -1) DESC, pos) AS rn FROM (
    SELECT image_id, pos, 'year' AS field_type, regexp_extract(text, '[0-9]{4}$') AS normalized_value, confidence FROM label_blocks WHERE regexp_matches(text, '[0-9]{4}$')))
WHERE rn = 1
""", ["label_blocks"])
def candidate_fields(t: Tables):
    return B.candidate_fields(t.label_blocks).select("image_id", "field_type", "normalized_value", "confidence")


@query("""
SELECT image_id, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM (
  SELECT image_id, regexp_extract(text, '[0-9]{4}$') AS y, max(confidence) AS c FROM label_blocks WHERE regexp_matches(text, '[0-9]{4}$') GROUP BY ALL)
WHERE c >= 0.8 GROUP BY 1
""", ["label_blocks"])
def vintage_evidence(t: Tables):
    years = B.vintage_evidence(B.candidate_fields(t.label_blocks))
    return years.select("image_id", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("""
SELECT image_id, round(sum(n * confidence) FILTER (n >= 3 AND confidence IS NOT NULL) / sum(n) FILTER (n >= 3 AND confidence IS NOT NULL), 6) AS text_confidence
FROM (SELECT *, length(regexp_replace(normalized_text, '[^\\pL]', '', 'g')) AS n FROM turns) GROUP BY 1
""", ["turns"])
def text_confidence(t: Tables):
    return rounded(A.text_confidence(t.turns))


@query("""
WITH n AS (SELECT *, lead(text) OVER w AS t2, lead(pos) OVER w AS p2, lead(confidence) OVER w AS c2 FROM turns WINDOW w AS (PARTITION BY image_id, variant ORDER BY pos))
SELECT image_id, variant, md5(text) AS digest, CAST(pos AS VARCHAR) AS positions, confidence FROM n
UNION ALL SELECT image_id, variant, md5(text || ' ' || t2), pos || ',' || p2, least(confidence, c2) FROM n WHERE p2 IS NOT NULL
""".replace("WITH n", "SELECT * FROM (WITH n", 1) + ")", ["turns"])
def adjacent_fragments(t: Tables):
    return W.adjacent_fragments(t.turns).select(
        "image_id", "variant", F.md5("text").alias("digest"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "confidence")


@query("""
SELECT a.image_id, a.pos, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (aa + ab - w * h) ELSE 0 END, 6) AS iou FROM (
  SELECT image_id, pos, least(max_x, 260) - greatest(min_x, 120) AS w, least(max_y, 100) - greatest(min_y, 20) AS h,
    (max_x - min_x) * (max_y - min_y) AS aa, 140 * 80 AS ab FROM label_blocks WHERE min_x IS NOT NULL) a
""", ["label_blocks"])
def box_iou(t: Tables):
    window = N.box_translate(F.struct(
        F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(140.0).alias("max_x"), F.lit(80.0).alias("max_y")),
        F.lit(120.0), F.lit(20.0))
    return rounded(t.label_blocks.where("box is not null").select("image_id", "pos", N.box_iou(F.col("box"), window).alias("iou")))


@query("""
SELECT image_id, 1 AS section, pos AS item, '- ' || text || ' [confidence: ' || CASE WHEN confidence IS NULL THEN 'n/a' ELSE format('{:.3f}', confidence) END || ', ' || variant || ']' AS line FROM label_blocks
UNION ALL SELECT image_id, s, i, l FROM (SELECT DISTINCT image_id FROM label_blocks), (VALUES
  (0, 0, 'Text Recognition Report'), (0, 1, '======================='), (0, 2, ''), (0, 3, 'Engine: sample'), (0, 4, 'Processing time, ms: 0.00'), (0, 5, ''),
  (0, 6, 'Raw lines'), (0, 7, '---------'), (2, 0, ''), (2, 1, 'Normalized text'), (2, 2, '---------------'), (2, 3, '(empty)'), (2, 4, ''),
  (3, 0, 'Candidate name'), (3, 1, '--------------'), (4, 0, '(none)'), (5, 0, ''), (6, 0, 'Candidate years'), (6, 1, '---------------'), (8, 0, ''),
  (9, 0, 'Candidate percentages'), (9, 1, '---------------------'), (10, 0, '(none)'), (11, 0, ''),
  (12, 0, 'Candidate volumes'), (12, 1, '-----------------'), (13, 0, '(none)'), (14, 0, '')) v(s, i, l)
UNION ALL SELECT image_id, 7, CAST(y AS BIGINT), '- ' || y || ' (raw: ' || y || ', confidence: ' || CASE WHEN c IS NULL THEN 'n/a' ELSE format('{:.3f}', c) END || ')' FROM (
  SELECT image_id, regexp_extract(text, '[0-9]{4}$') AS y, max(confidence) AS c FROM label_blocks WHERE regexp_matches(text, '[0-9]{4}$') GROUP BY ALL)
UNION ALL SELECT image_id, 7, 0, '(none)' FROM label_blocks GROUP BY 1 HAVING count(*) FILTER (regexp_matches(text, '[0-9]{4}$')) = 0
""", ["label_blocks"], big=["section"])
def render_text_report(t: Tables):
    blocks = t.label_blocks
    images = blocks.select("image_id").distinct().select(
        "image_id", F.lit("sample").alias("engine"), F.lit(0.0).alias("processing_time_ms"),
        F.array().cast("array<string>").alias("warnings"), F.lit("").alias("normalized_text"))
    fields = B.candidate_fields(blocks).withColumns({
        "field_no": F.col("normalized_value").cast("long"), "variant": F.lit(None).cast("string")})
    return reports.render_text_report(images, blocks, fields)
