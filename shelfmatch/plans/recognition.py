"""Fuse the branches of every query into one ranked, explained decision.

A shortlist holds at most 20 items and 10 rescued ones (``validate_shortlist``, ``top_scores``), so
windows over one query are bounded; everything before that bound is a pre-aggregated top-k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators.ranking import single_exact_reference, stable_ties, top_scores, vintage_class, vintage_rerank
from shelfmatch.operators.windows import canonical_reference
from shelfmatch.skew import rank_bounded


def _per_query():
    return Window.partitionBy("query_id")


def _gathered(cards: DataFrame, place: str, **branches: DataFrame) -> DataFrame:
    """One row per (query, slug) of all branches: the columns of ``cards``, one score per branch, ``__listed``.

    The branches are stacked and move once, by query: grouping by slug and every later window over a query
    happen where the rows are. A slug that ``cards`` lists more than once keeps its first place; a score
    given more than once is the best one.
    """
    keys = ["query_id", "slug"]
    own = [c for c in cards.columns if c not in keys]
    parts = [cards.select(*keys, F.struct(*own).alias("__card"), F.col(place).alias("__place"))]
    parts += [scores.select(*keys, F.col("score").alias(name)) for name, scores in branches.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = stacked.repartition("query_id").groupBy(*keys).agg(
        F.min_by("__card", "__place").alias("__card"), *[F.max(name).alias(name) for name in branches])
    return rows.select(*keys, "__card.*", *branches, F.col("__card").isNotNull().alias("__listed"))


def text_quality(evidence: DataFrame, producers: DataFrame, matches: DataFrame) -> DataFrame:
    """Whether a query's recognised text can lead the fusion, with the first reason against it.

    ``evidence``: query_id, text, text_confidence; ``producers``: (query_id, word) rows;
    ``matches``: the queries' text scores.
    """
    words = evidence.select(
        "query_id", "text_confidence", X.word_set(F.coalesce("text", F.lit(""))).alias("words")
    )
    # Candidates of a query are bounded, and so are their producer words.
    vocabulary = producers.groupBy("query_id").agg(F.collect_set("word").alias("producer"))
    available = matches.select("query_id").distinct().withColumn("available", F.lit(True))
    joined = words.join(vocabulary, "query_id", "left").join(available, "query_id", "left")
    empty = F.array().cast("array<string>")
    judged = joined.withColumns(_quality_columns(
        F.col("words"), F.coalesce("producer", empty), F.coalesce("available", F.lit(False)), F.col("text_confidence")))
    return judged.select(
        "query_id", (F.col("text_reason") == "sufficient_text").alias("sufficient"), F.col("text_reason").alias("reason"),
        "word_count", "informative_word_count", "recognition_confidence")


def _quality_columns(words: Column, producer: Column, available: Column, conf: Column) -> dict[str, Column]:
    generic = F.array(*[F.lit(w) for w in K.GENERIC_WORDS])
    informative = F.array_except(F.array_except(words, generic), producer)
    valid = F.coalesce(N.is_finite(conf) & conf.between(0, 1), F.lit(False))
    little = (
        (F.size(words) < K.MIN_TEXT_WORDS) | (F.size(informative) < K.MIN_INFORMATIVE_WORDS)
        | (X.letters_in(informative) < K.MIN_INFORMATIVE_LETTERS)
    )
    reason = (
        F.when(~available, "no_text_matches").when(little, "too_little_distinctive_text")
        .when(~valid, "recognition_confidence_missing").when(conf < K.MIN_TEXT_CONFIDENCE, "low_recognition_confidence")
        .otherwise("sufficient_text")
    )
    return {
        "text_reason": reason, "word_count": F.size(words), "informative_word_count": F.size(informative),
        "recognition_confidence": F.when(valid, conf),
    }


def fuse(candidates: DataFrame, visual: DataFrame, text: DataFrame, quality: DataFrame | None = None,
         text_weight: float = 0.5, palette: DataFrame | None = None) -> DataFrame:
    """Rank the shortlist of every query by fused score, with the query's mode.

    ``candidates``: query_id, slug, score (image score or NULL), src_order and any card columns;
    ``visual`` and ``text``: query_id, slug, score. With ``quality`` the text weight is .7 when the
    text is sufficient and .3 otherwise, and the rows carry ``sufficient`` and ``text_reason`` for ``decide``.
    With ``palette`` they carry ``palette_score`` for ``blend_palette``. Missing scores stay NULL in the output.
    """
    extra = {} if palette is None else {"palette_score": palette}
    rows = _gathered(candidates, "src_order", visual_score=visual, text_score=text, **extra)
    if quality is not None:
        why = F.col("reason") if "reason" in quality.columns else F.lit(None).cast("string")
        rows = rows.join(quality.select("query_id", "sufficient", why.alias("text_reason")), "query_id", "left")
        leads = F.coalesce("sufficient", F.lit(False))
        weight = F.when(leads, K.TEXT_WEIGHT_SUFFICIENT).otherwise(K.TEXT_WEIGHT_SPARSE)
    else:
        leads, weight = F.lit(False), F.lit(text_weight)
    ranked = _fuse_rows(rows.withColumn("image_score", F.col("score")), leads, weight)
    return ranked.drop("distance")


def _fuse_rows(rows: DataFrame, leads: Column, weight: Column) -> DataFrame:
    """Fused and ranked shortlist rows.

    ``rows``: every (query, slug) with a shortlist place (``__listed``), a visual or a text score.
    Shared keys count wherever they are; geometry counts only inside the shortlist.
    """
    return stable_ties(_fused_scores(rows.withColumns(_query_flags()).where("__listed"), leads, weight))


def _query_flags() -> dict[str, Column]:
    """Whether a query has geometry inside its shortlist, keys shared by geometry and text, and any text."""
    vis, txt = F.col("visual_score"), F.col("text_score")
    any_of = lambda c: F.coalesce(F.bool_or(c).over(_per_query()), F.lit(False))
    return {"__geo": any_of(F.col("__listed") & (vis > 0)), "__shared": any_of(vis.isNotNull() & txt.isNotNull()),
            "__text": any_of(txt.isNotNull())}


def _fused_scores(rows: DataFrame, leads: Column, weight: Column) -> DataFrame:
    """Mode and fused score of listed rows that carry ``_query_flags``; members of the mode stay."""
    vis, txt, img = F.col("visual_score"), F.col("text_score"), F.col("image_score")
    flagged = rows.withColumns({"__lead": leads & F.col("__text"), "text_weight": weight})
    w, v = F.col("text_weight"), F.lit(1.0) - F.col("text_weight")
    lead, geo, zero = F.col("__lead"), F.col("__geo"), F.lit(0.0)
    # Mode names.
    mode = (
        F.when(lead & geo, "text_primary").when(lead, "text_primary_dino").when(geo & F.col("__shared"), "weighted_visual")
        .when(geo, "visual_fallback").otherwise("dino_fallback")
    )
    scored = vis.isNotNull() | txt.isNotNull()
    member = (
        F.when(lead & geo, scored).when(lead, scored | img.isNotNull()).when(geo, F.coalesce(vis > 0, F.lit(False)))
        .otherwise(img.isNotNull())
    )
    fused = (
        F.when(lead & geo, v * F.coalesce(vis, zero) + w * F.coalesce(txt, zero))
        .when(lead, v * F.greatest(zero, F.coalesce(img, zero)) + w * F.coalesce(txt, zero))
        .when(geo, v * vis + w * F.coalesce(txt, zero)).otherwise(v * img)
    )
    out = flagged.withColumn("mode", mode).where(member).withColumn("score", fused)
    return out.drop("__geo", "__shared", "__text", "__lead", "__listed")


def blend_palette(ranked: DataFrame, palette: DataFrame | None = None, weight: float = K.PALETTE_WEIGHT) -> DataFrame:
    """Mix in palette similarity; unknown palettes are neutral, a query without any is unchanged.

    Without ``palette`` the rows carry ``palette_score`` themselves, as ``fuse`` with a palette gives them.
    """
    if not 0 <= weight <= 0.1:
        raise ValueError("palette weight must be between zero and 0.1")
    if palette is None:
        return _blend_rows(ranked, weight)
    joined = ranked.join(
        palette.select("query_id", "slug", F.col("score").alias("palette_score")), ["query_id", "slug"], "left"
    )
    return _blend_rows(joined, weight)


def _blend_rows(rows: DataFrame, weight: float) -> DataFrame:
    known = F.max("palette_score").over(_per_query()).isNotNull()
    blended = rows.withColumn("palette_used", known).withColumns({
        "fusion_score": F.col("score"), "score": _blended(weight), "__before": F.col("rank"),
    }).drop("rank")
    return rank_bounded(blended, ["query_id"], [F.desc("score"), F.col("__before")]).drop("__before")


def _blended(weight: float) -> Column:
    mixed = (F.lit(1.0) - weight) * F.col("score") + F.lit(weight) * F.coalesce("palette_score", F.lit(K.NEUTRAL_PALETTE))
    return F.when(F.col("palette_used"), mixed).otherwise(F.col("score"))


def apply_vintage(ranked: DataFrame, years: DataFrame) -> DataFrame:
    """Prefer candidates of the one detected year; adds detected_year and vintage_state.

    ``years``: query_id and the array of years read.
    """
    again = vintage_rerank(_with_year(ranked.join(years, "query_id", "left")))
    chosen = F.max(F.when(F.col("rank") == 1, F.col("vintage"))).over(_per_query())
    return again.withColumn("vintage_state", _vintage_state(chosen)).drop("__years")


def _with_year(rows: DataFrame) -> DataFrame:
    distinct = F.array_distinct(F.coalesce("years", F.array().cast("array<int>")))
    return rows.withColumns({
        "detected_year": F.when(F.size(distinct) == 1, distinct[0]), "__years": F.size(distinct),
    }).drop("years")


def _vintage_state(chosen: Column) -> Column:
    return (
        F.when(F.col("__years") == 0, "not_read").when(F.col("__years") > 1, "ambiguous")
        .when(chosen == F.col("detected_year"), "matched").when(chosen.isNull(), "unverified")
        .otherwise("mismatch")
    )


def prefer_confirmed(ranked: DataFrame) -> DataFrame:
    """Move the only candidate that matches a user-confirmed photo to the front."""
    marked = single_exact_reference(ranked, _exact_reference())
    confirmed = F.bool_or("promoted").over(_per_query())
    again = rank_bounded(
        marked.withColumn("confirmed", confirmed), ["query_id"], [F.col("promoted").desc(), F.col("rank")], "__rank"
    ).withColumn("rank", F.col("__rank")).drop("__rank")
    if "vintage_state" not in ranked.columns:
        return again
    # The promoted row answers the vintage check for itself.
    own = F.max(F.when(F.col("promoted"), F.col("vintage"))).over(_per_query())
    return again.withColumn("vintage_state", _confirmed_state(own))


def _exact_reference() -> Column:
    return (
        F.col("best_image_uri").startswith(K.FEEDBACK_PREFIX)
        & (F.coalesce("image_score", F.lit(0.0)) >= K.EXACT_IMAGE)
        & (F.coalesce("visual_score", F.lit(0.0)) >= K.EXACT_GEOMETRY)
    )


def _confirmed_state(own: Column) -> Column:
    year = F.col("detected_year")
    return F.when(
        F.col("confirmed") & year.isNotNull(),
        F.when(own == year, "matched").when(own.isNull(), "unverified").otherwise("mismatch"),
    ).otherwise(F.col("vintage_state"))


def decide(
    ranked: DataFrame, quality: DataFrame | None = None, min_score: float = K.MIN_SCORE, min_margin: float = K.MIN_MARGIN,
    min_geometry: float = K.MIN_GEOMETRY,
) -> DataFrame:
    """One decision per query with its reason, margin and the scores of the first candidate.

    Without ``quality`` the rows carry sufficient and text_reason themselves.
    """
    state = F.col("vintage_state")
    # With a matching year, only candidates of that or an unknown year compete.
    rival = (F.col("rank") > 1) & (
        (state != "matched") | F.col("vintage").isNull() | (F.col("vintage") == F.col("detected_year"))
    )
    top_columns = [
        "slug", "score", "visual_score", "image_score", "text_score", "vintage_state", "detected_year", "confirmed",
        "mode", "text_weight",
    ] + (["sufficient", "text_reason"] if quality is None else []) + [
        c for c in ("visual_count", "rescue_count", "geometry_count", "text_count") if c in ranked.columns
    ]
    per = ranked.groupBy("query_id").agg(
        F.min_by(F.struct(*top_columns), F.col("rank")).alias("t"),
        F.min_by(F.when(rival, F.col("score")), F.when(rival, F.col("rank"))).alias("next_score"),
        F.count(F.lit(1)).alias("candidates"),
    ).select("query_id", "t.*", "next_score", "candidates")
    if quality is not None:
        per = per.join(quality.select("query_id", "sufficient", F.col("reason").alias("text_reason")), "query_id", "left")
    geometry, image = F.coalesce("visual_score", F.lit(0.0)), F.coalesce("image_score", F.lit(0.0))
    supported = (geometry >= min_geometry) | (image >= K.EXACT_IMAGE) | (
        F.coalesce("sufficient", F.lit(False)) & (geometry >= K.SUPPORT_GEOMETRY) & (image >= K.SUPPORT_IMAGE)
    )
    margin = F.col("score") - F.col("next_score")
    reason = (
        F.when(F.col("confirmed"), "confirmed_reference").when(state == "mismatch", "vintage_mismatch")
        .when(F.col("score") < min_score, "weak_score")
        .when(F.coalesce(margin < min_margin, F.lit(False)), "ambiguous_candidates")
        .when(~supported, "insufficient_visual_support").otherwise("supported_match")
    )
    return per.select(
        "query_id", "slug", reason.isin("supported_match", "confirmed_reference").alias("accepted"),
        reason.alias("reason"), "score", margin.alias("margin"), "visual_score", "image_score", "text_score",
        "vintage_state", "detected_year", "mode", "text_weight", "text_reason", "candidates",
        *[c for c in ("visual_count", "rescue_count", "geometry_count", "text_count") if c in per.columns],
    )


def recognize_batch(
    visual: DataFrame, verified: DataFrame, text: DataFrame, evidence: DataFrame, refs: DataFrame, cards: DataFrame,
    palette: DataFrame | None = None, queries: DataFrame | None = None, palette_weight: float = K.PALETTE_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """Decisions and ranked candidates of all queries.

    ``visual``: the shortlist of ``search_items`` with model_name; ``verified``: geometric scores by
    (query_id, slug), also of rescued items; ``text``: text scores by (query_id, slug); ``evidence``:
    query_id, text, text_confidence, years; ``cards``: one row per slug with name, winery and
    vintage. A query of ``queries`` without a visual shortlist gets a failed decision; a missing text
    or geometric branch only adds a warning.

    The branches meet in one row per (query, slug), item facts are looked up once by slug, and
    everything after that happens inside a query, so candidates move three times in all.
    """
    rows = _branches(visual, verified, text, refs, cards, palette)
    return recognize_gathered(rows, evidence, queries, palette_weight if palette is not None else 0)


def recognize_gathered(
    rows: DataFrame, evidence: DataFrame, queries: DataFrame | None = None, palette_weight: float = K.PALETTE_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """``recognize_batch`` of candidates whose branches were gathered before, as ``branch_tops`` gives them."""
    ranked = rank_gathered(rows, evidence, palette_weight)
    decisions = decide(ranked)
    decisions = decisions.withColumns({
        "warnings": F.filter(F.array(
            F.when(F.col("geometry_count") == 0, "geometry_unavailable"),
            F.when(F.col("text_count") == 0, "text_unavailable"),
        ), lambda w: w.isNotNull()), "status": F.lit("ok"),
    })
    if queries is not None:
        decisions = queries.select("query_id").join(decisions, "query_id", "left").withColumn(
            "status", F.coalesce("status", F.lit("visual_retrieval_unavailable"))
        )
    return decisions, ranked


def recognition_answers(decisions: DataFrame, cards: DataFrame, evidence: DataFrame, card_url: str, version: str) -> DataFrame:
    """Whole answers of ``recognize_batch``: every column of its decisions and

    * ``card``: all columns of the first candidate's card (one row per slug), and its address ``item_url``,
    * ``weights``: what image and text counted, ``evidence``: what was read from the photo,
    * ``pipeline_version``.

    Cards meet decisions by slug and evidence by query, each once; a query without a candidate keeps
    nulls.
    """
    by_slug = cards.select(F.col("slug").alias("__slug"), F.struct("*").alias("card"))
    read = evidence.select(F.col("query_id").alias("__query"), F.struct(*[c for c in evidence.columns if c != "query_id"]).alias("evidence"))
    address = F.concat(F.lit(card_url.rstrip("/") + "/"), _quoted(F.col("slug")))
    joined = decisions.join(by_slug, F.col("slug") == F.col("__slug"), "left").join(read, F.col("query_id") == F.col("__query"), "left")
    weights = F.struct(F.round(1 - F.col("text_weight"), 1).alias("visual"), F.col("text_weight").alias("text"))
    return joined.select(
        *decisions.columns, "card", address.alias("item_url"), F.when(F.col("text_weight").isNotNull(), weights).alias("weights"), "evidence",
        F.lit(version).alias("pipeline_version"))


def _quoted(c: Column) -> Column:
    """Percent-encoded path part: letters, digits and ``-_.~`` stay."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def item_facts(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """Card facts, producer words and the canonical reference per model of every slug."""
    canonical = canonical_reference(refs).groupBy("slug").agg(F.map_from_entries(F.collect_list(
        F.struct("model_name", F.struct("item_id", F.col("image_uri").alias("uri")))
    )).alias("__refs"))  # one entry per model
    facts = cards.select(
        "slug", "name", "winery", "vintage", X.word_set(F.coalesce("winery", F.lit(""))).alias("__producer"))
    return facts.join(canonical, "slug", "full")


def _branches(visual, verified, text, refs, cards, palette) -> DataFrame:
    keys = ["query_id", "slug"]
    listed = visual.select(
        *keys, "item_id", "best_image_uri", "model_name", F.col("score").alias("image_score"), F.col("rank").alias("src_order"))
    branches = {"text_score": text, "visual_score": top_scores(verified, K.BRANCH_LIMIT, "slug")}
    if palette is not None:
        branches["palette_score"] = palette
    rows = _gathered(listed, "src_order", **branches).withColumnRenamed("__listed", "__visual")
    # A palette score alone makes no candidate.
    rows = rows.where(F.col("__visual") | F.col("text_score").isNotNull() | F.col("visual_score").isNotNull())
    if palette is None:
        rows = rows.withColumn("palette_score", F.lit(None).cast("double"))
    return rows.join(item_facts(cards, refs), "slug", "left")


def branch_tops(rows: DataFrame) -> DataFrame:
    """Gathered branches out of rows that carry the scores of all of them: each keeps its best of a query.

    ``rows``: one row per (query, slug) with ``photo`` (whether the photo search found it), item_id, best_image_uri,
    model_name, image_score, visual_score, text_score, palette_score and the columns of ``item_facts``. They move
    once, by query; a query has a row per slug at most, ranks over it are read in order, and 40 of them stay.
    """
    query = _per_query()
    best = lambda *order: F.row_number().over(query.orderBy(*order, F.col("slug")))
    ranked = rows.repartition("query_id").withColumns({
        "src_order": best(F.desc("photo"), F.desc("image_score")).cast("long"),
        "__vis": best(F.desc("visual_score")), "__txt": best(F.desc("text_score")),
    })
    listed = F.col("photo") & (F.col("src_order") <= K.SHORTLIST_LIMIT)
    own = lambda c: F.when(F.col("__visual"), F.col(c))
    top = lambda c, place: F.when(F.col(place) <= K.BRANCH_LIMIT, F.col(c))
    cut = ranked.withColumn("__visual", listed).withColumns({
        **{c: own(c) for c in ("item_id", "best_image_uri", "model_name", "image_score", "src_order")},
        "visual_score": top("visual_score", "__vis"), "text_score": top("text_score", "__txt"),
    }).drop("photo", "__vis").withColumnRenamed("__txt", "text_place")
    return cut.where(F.col("__visual") | F.col("text_score").isNotNull() | F.col("visual_score").isNotNull())


def rank_gathered(rows: DataFrame, evidence: DataFrame, palette_weight: float = K.PALETTE_WEIGHT) -> DataFrame:
    """Ranked candidates of all queries: ``fuse_gathered``, ``blend_palette``, ``apply_vintage`` and ``prefer_confirmed``.

    The same rows as these one after another, which would each sort a query anew: one sort by all their orders gives
    the ranks, and the one promoted row only shifts those before it.
    """
    ranked = date_gathered(rows, evidence, palette_weight)
    place = F.max(F.when(F.col("promoted"), F.col("rank"))).over(_per_query())
    rank = F.when(F.col("promoted"), 1).when(F.col("rank") < F.col("__place"), F.col("rank") + 1).otherwise(F.col("rank"))
    again = ranked.withColumn("__place", place).withColumn("rank", rank.cast("long")).drop("__place")
    return again.withColumn("vintage_state", _confirmed_state(F.col("__own"))).drop("__own")


def date_gathered(rows: DataFrame, evidence: DataFrame, palette_weight: float = K.PALETTE_WEIGHT) -> DataFrame:
    """``rank_gathered`` before the confirmed photo moves to the front."""
    query = _per_query()
    fused = _fuse_gathered(rows, evidence)
    exact = _exact_reference()
    seen = fused.withColumn("__exact", F.coalesce(exact, F.lit(False))).withColumns({
        "palette_used": F.max("palette_score").over(query).isNotNull(), "__count": F.count_if("__exact").over(query),
        "__own": F.max(F.when(F.col("__exact"), F.col("vintage"))).over(query),
    }).withColumns({
        "promoted": F.col("__exact") & (F.col("__count") == 1), "confirmed": F.col("__count") == 1,
    }).drop("__exact", "__count")
    if palette_weight > 0:
        seen = seen.withColumn("fusion_score", F.col("score")).withColumn("score", _blended(palette_weight))
        order = [F.desc("score"), F.desc("fusion_score"), F.col("src_order")]
    else:
        seen, order = seen.drop("palette_used"), [F.desc("score"), F.col("src_order")]
    dated = _with_year(seen)
    first = query.orderBy(vintage_class(), *order)
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dated.withColumns({"rank": F.row_number().over(first).cast("long"), "__chosen": F.first("vintage").over(whole)})
    return ranked.withColumn("vintage_state", _vintage_state(F.col("__chosen"))).drop("__years", "__chosen")


def fuse_gathered(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates ranked by fused score, with rescued text hits and the quality of the query's text."""
    return stable_ties(_fuse_gathered(rows, evidence))


def _fuse_gathered(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    # Texts are dealt by query before their words are read: a small file is a single task of its reader.
    facts = evidence.select("query_id", "text_confidence", "years", "text").repartition("query_id").select(
        "query_id", "text_confidence", "years", X.word_set(F.coalesce("text", F.lit(""))).alias("__words"))
    query = _per_query()
    count = lambda c: F.count_if(c).over(query)
    rows = rows.join(facts, "query_id", "left").withColumns({
        "__model": F.max("model_name").over(query), "visual_count": count(F.col("__visual")),
        "geometry_count": count(F.col("visual_score").isNotNull()), "text_count": count(F.col("text_score").isNotNull()),
    })
    # Text hits the photo missed join the list when their item has a reference of the same model.
    reference = F.try_element_at("__refs", F.coalesce("__model", F.lit("")))
    rescued = ~F.col("__visual") & F.col("text_score").isNotNull() & reference.isNotNull()
    rows = rows.withColumns({"rescued": rescued, "__ref": reference}).drop("__refs")
    # Places among the query's text hits, or among the rescued ones: either way in the same order.
    place = F.col("text_place") if "text_place" in rows.columns else F.row_number().over(
        query.orderBy(F.col("rescued").desc(), F.desc("text_score"), F.col("slug")))
    fill = lambda name, value: F.when(F.col("rescued"), value).otherwise(F.col(name))
    rows = rows.withColumns({
        "__listed": F.col("__visual") | F.col("rescued"), "src_order": fill("src_order", place + K.SHORTLIST_LIMIT),
        "item_id": fill("item_id", F.col("__ref.item_id")), "best_image_uri": fill("best_image_uri", F.col("__ref.uri")),
    }).withColumns({
        "rescue_count": count(F.col("rescued")), **_query_flags(),
        "__vocabulary": F.flatten(F.collect_set(F.when(F.col("__listed"), F.col("__producer"))).over(query)),
    })
    rows = rows.where("__listed").withColumns(_quality_columns(
        F.coalesce("__words", F.array().cast("array<string>")), F.col("__vocabulary"), F.col("text_count") > 0, F.col("text_confidence")))
    rows = rows.withColumn("sufficient", F.col("text_reason") == "sufficient_text").drop(
        "__vocabulary", "__words", "__producer", "__ref", "__model", "__visual", "text_place")
    weight = F.when(F.col("sufficient"), K.TEXT_WEIGHT_SUFFICIENT).otherwise(K.TEXT_WEIGHT_SPARSE)
    return _fused_scores(rows, F.col("sufficient"), weight)


def resolve_label(
    facts: DataFrame, matches: DataFrame, cards: DataFrame, card_url: str,
    min_similarity: float = K.LABEL_MIN_SIMILARITY, min_margin: float = K.LABEL_MIN_MARGIN,
) -> DataFrame:
    """Catalog item named by user facts: by an exact card address, or by a clear text match.

    ``facts``: query_id, name, year, locality, winery, notes; ``matches``: text scores with slug and
    rank for the facts' text; ``cards``: one row per slug with vintage.
    """
    fields = ["name", "year", "locality", "winery", "notes"]
    prefix = card_url.rstrip("/") + "/"
    pattern = "\\Q" + prefix + "\\E[a-z0-9][a-z0-9_-]*"
    urls = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(pattern), F.lit(0)))
    named = [c for c in fields if c != "year"]
    # The first field that holds an address decides.
    first = F.coalesce(*[F.when(F.size(urls(c)) > 0, urls(c)) for c in named])
    rows = facts.select(
        "query_id", "year", first.alias("urls"),
        X.informative_words(F.concat_ws("\n", *[X.clean_value(F.col(c).cast("string")) for c in fields])).alias("words"),
    ).withColumn("url_slug", F.when(F.size("urls") == 1, F.substr(F.col("urls")[0], F.lit(len(prefix) + 1))))
    known = cards.select(F.col("slug").alias("url_slug"), F.lit(True).alias("url_known"))
    top = matches.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.min_by("slug", "rank").alias("top_slug"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("similarity"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    ).join(cards.select(F.col("slug").alias("top_slug"), "vintage"), "top_slug", "left")
    joined = rows.join(known, "url_slug", "left").join(top, "query_id", "left")
    margin = F.col("similarity") - F.col("second")
    clear = F.coalesce((F.col("similarity") >= min_similarity) & (margin >= min_margin), F.lit(False))
    vague = (F.size("words") < K.LABEL_MIN_WORDS) | (X.letters_in(F.col("words")) < K.LABEL_MIN_LETTERS)
    by_url = F.col("urls").isNotNull()
    wrong_year = F.coalesce((F.col("year") != 0) & (F.col("vintage") != F.col("year")), F.lit(False))
    reason = (
        F.when(by_url & (F.size("urls") > 1), "conflicting_identifiers").when(by_url & F.col("url_known").isNull(), "unknown_identifier")
        .when(by_url, "catalog_identifier").when(vague, "insufficient_information")
        .when(F.col("similarity").isNull(), "no_catalog_match").when(~clear, "ambiguous_text_match")
        .when(wrong_year, "vintage_mismatch").otherwise("text_match")
    )
    accepted = reason.isin("catalog_identifier", "text_match")
    return joined.select(
        "query_id", accepted.alias("accepted"), reason.alias("reason"),
        F.when(accepted, F.when(by_url, F.col("url_slug")).otherwise(F.col("top_slug"))).alias("slug"),
        F.when(~by_url, F.col("similarity")).alias("similarity"), F.when(~by_url, margin).alias("margin"),
    )
