"""Lookups, existence tests and pairings between tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators.windows import canonical_reference
from shelfmatch.session import cut_lineage
from shelfmatch.skew import banded_rank, top_per_key


def feedback_with_samples(feedback: DataFrame, samples: DataFrame) -> DataFrame:
    return feedback.join(samples, "image_sha256")


def has_job(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists in the other table."""
    return df.join(other, key, "left_semi")


slug_exists = has_job


def unreferenced(refs: DataFrame, feedback: DataFrame) -> DataFrame:
    """References that no feedback row points to."""
    used = feedback.where(F.col("reference_uri").isNotNull()).select(F.col("reference_uri").alias("image_uri"))
    return refs.join(used, "image_uri", "left_anti")


def prune_candidates(refs: DataFrame, keep: DataFrame, model: str) -> DataFrame:
    """Same-model references outside the keep list."""
    return refs.where(F.col("model_name") == model).join(keep, "image_uri", "left_anti")


def label_conflicts(feedback: DataFrame) -> DataFrame:
    """(photo, label) rows of photos that were confirmed under several labels.

    Two labels differ exactly when the smallest and largest do, so jobs are never paired.
    """
    ready = feedback.where((F.col("embedding_state") == "ready") & F.col("correct_slug").isNotNull())
    labels = ready.groupBy("image_sha256", F.col("correct_slug").alias("label")).agg(
        F.count(F.lit(1)).alias("jobs")
    )
    several = labels.groupBy("image_sha256").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return labels.join(several.where("a <> b").select("image_sha256"), "image_sha256", "left_semi")


def unknown_ids(ids: DataFrame, known: DataFrame, key: str = "item_id") -> DataFrame:
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def ids_to_slugs(scores: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best score per (query, slug), and the score rows whose id the catalog does not know."""
    lookup = catalog.select(F.col("id").cast("string").alias("item_id"), "slug")
    known = scores.join(lookup, "item_id").groupBy("query_id", "slug").agg(F.max("score").alias("score"))
    return known, scores.join(lookup, "item_id", "left_anti")


def enrich_candidates(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    return candidates.join(cards, "slug", "left")


def rescue_candidates(visual: DataFrame, text: DataFrame, refs: DataFrame) -> DataFrame:
    """The visual shortlist followed by text hits it missed, each with its canonical reference.

    ``visual`` carries ``src_order`` from 1 and the query's model; rescued rows have no image score
    and come after every visual row, best text first. Of longer lists the first twenty visual rows and the
    ten best text hits count, as in a search.
    """
    keys, per_query = ["query_id", "slug"], Window.partitionBy("query_id")
    visual = visual.where(F.col("src_order") <= K.SHORTLIST_LIMIT)
    best = top_per_key(text.select(*keys, "score"), ["query_id"], [F.desc("score"), F.col("slug")], K.BRANCH_LIMIT)
    hits = best.select(*keys, F.col("score").alias("__text"))
    # A query has thirty rows at most: both lists move once, by query, and meet there.
    own = F.struct(*[c for c in visual.columns if c not in keys])
    both = visual.select(*keys, own.alias("__row")).unionByName(hits, allowMissingColumns=True).repartition("query_id").groupBy(*keys).agg(
        F.collect_list("__row").alias("__rows"), F.max("__text").alias("__text")
    ).select(*keys, "__text", F.explode_outer("__rows").alias("__row")).select(*keys, "__text", "__row.*", F.col("__row").isNotNull().alias("__listed"))
    both = both.withColumn("__model", F.max("model_name").over(per_query))
    lookup = canonical_reference(refs).select(
        "slug", F.col("model_name").alias("__model"), F.col("item_id").alias("__item"), F.col("image_uri").alias("__uri"))
    found = both.join(lookup, ["slug", "__model"], "left").where(F.col("__listed") | F.col("__uri").isNotNull())
    fresh = ~F.col("__listed")
    place = F.row_number().over(per_query.orderBy(F.col("__listed"), F.desc("__text"), F.col("slug")))
    fill = lambda name, value: F.when(fresh, value).otherwise(F.col(name)).alias(name)
    filled = {
        "item_id": F.col("__item"), "best_image_uri": F.col("__uri"), "model_name": F.col("__model"),
        "src_order": place + K.SHORTLIST_LIMIT,
    }
    return found.select(
        *[fill(c, filled[c]) if c in filled else F.col(c) for c in visual.columns], fresh.alias("rescued"))


def match_photo_names(names: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest row per wanted photo name, and the candidate files of ambiguous names.

    Files are first counted per (key, suffix); a name is joined to these counts, never to files, so
    a key shared by many names and many files does not multiply. The candidate table is keyed by
    ``photo_key`` and ``suffix`` (NULL: every suffix) and is not repeated per name.
    """
    stored = files.where(
        X.file_suffix(F.col("relative_path")).isin(K.IMAGE_SUFFIXES)
        & ~X.base_name(F.col("relative_path")).rlike(K.VARIANT_PREFIX)
    ).select(
        "relative_path", X.photo_key(F.col("relative_path")).alias("photo_key"),
        X.file_suffix(F.col("relative_path")).alias("suffix"),
    )
    per_suffix = stored.groupBy("photo_key", "suffix").agg(
        F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("path")
    )
    per_key = per_suffix.groupBy("photo_key").agg(F.sum("n").alias("n"), F.min("path").alias("path"))
    wanted = names.select("dataset_photo").distinct().select(
        "dataset_photo", X.photo_key(F.col("dataset_photo")).alias("photo_key"),
        X.file_suffix(F.col("dataset_photo")).alias("suffix"),
    )
    same = per_suffix.select("photo_key", "suffix", F.col("n").alias("n_same"), F.col("path").alias("path_same"))
    joined = wanted.join(per_key, "photo_key", "left").join(same, ["photo_key", "suffix"], "left")
    count = F.coalesce("n_same", "n", F.lit(0)).cast("long")
    manifest = joined.select(
        "dataset_photo", "photo_key",
        F.when(F.col("n_same").isNotNull(), F.col("suffix")).alias("candidate_suffix"),
        F.when(count == 1, F.coalesce("path_same", "path")).otherwise(F.lit("")).alias("relative_path"),
        F.when(count == 1, "matched").when(count > 1, "ambiguous").otherwise("missing").alias("status"),
        count.alias("candidate_count"),
    )
    open_keys = manifest.where("status = 'ambiguous'").select("photo_key", "candidate_suffix").distinct()
    by_suffix = stored.join(
        open_keys.where("candidate_suffix is not null").withColumnRenamed("candidate_suffix", "suffix"),
        ["photo_key", "suffix"], "left_semi",
    )
    any_suffix = stored.join(open_keys.where("candidate_suffix is null"), "photo_key", "left_semi")
    candidates = by_suffix.select("photo_key", F.col("suffix").alias("candidate_suffix"), "relative_path").unionByName(
        any_suffix.select("photo_key", F.lit(None).cast("string").alias("candidate_suffix"), "relative_path")
    )
    return manifest, candidates


def eval_queries_vs_index(queries: DataFrame, refs: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled queries whose item is indexed, and the rest as error rows."""
    indexed = refs.select("item_id", "model_name").distinct()
    if model is not None:
        indexed = indexed.where(F.col("model_name") == model)
    on = (queries["expected"] == indexed["item_id"]) & (queries["model_name"] == indexed["model_name"])
    errors = queries.join(indexed, on, "left_anti").withColumn("error_type", F.lit("item_not_indexed"))
    return queries.join(indexed, on, "left_semi"), errors


def pair_variants(metrics: DataFrame, value: str, baseline: str = "A") -> DataFrame:
    """Every other variant of a sample beside the baseline value."""
    base = metrics.where(F.col("variant") == baseline).select("sample_id", F.col(value).alias("baseline"))
    other = metrics.where(F.col("variant") != baseline).select(
        "sample_id", "variant", F.col(value).alias("candidate")
    )
    return other.join(base, "sample_id")


#: Queries and photos of an item that meet in one cell.
QUERIES, PHOTOS = 504, 1024


def references_by_item(ids: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, item, photo) rows of requested items, and requested items without a photo.

    The result is the product of an item's queries and its photos, so an item is dealt into pieces of QUERIES
    queries and PHOTOS photos. Each pair of pieces is a cell, and cells are dealt over tasks, so that no
    item makes its rows in one task. A cell lists its queries in the same order for one photo after another:
    in a file the photo stands still and the queries repeat. Pieces are of equal size, since Parquet packs
    numbers in runs of 504, which are alike then and compress. Rows are numbered inside an item by numbers
    that are written once: copies of a row spread as other rows do.
    """
    numbered = lambda df: cut_lineage(df.withColumn("__n", F.monotonically_increasing_id()))
    asked, photos = numbered(ids), numbered(refs.select("item_id", "image_uri"))
    counted = lambda df, name: df.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    stored = counted(photos, "__photos")
    sizes = counted(asked, "__asked").join(stored, "item_id")
    # A fixed number of partitions: rows that meet are few and small, what they make is not.
    cell, parts = ["item_id", "__q", "__p"], int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, size: int, other: str, pieces: Column) -> DataFrame:
        placed = banded_rank(df.join(sizes, "item_id"), ["item_id"], [F.col("__n")], F.shiftright("__n", 15), "__place")
        every = F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))
        return placed.withColumns({own: F.floor((F.col("__place") - 1) / size), other: every}).drop(
            "__n", "__place", "__asked", "__photos").repartition(parts, *cell)

    # A merge reads the left side's rows in turn, each beside all of its cell's on the right; a broadcast may turn sides.
    met = dealt(photos, "__p", PHOTOS, "__q", F.ceil(F.col("__asked") / QUERIES)).hint("merge").join(
        dealt(asked, "__q", QUERIES, "__p", F.ceil(F.col("__photos") / PHOTOS)), cell)
    found = met.select("item_id", *[c for c in ids.columns if c != "item_id"], "image_uri")
    return found, asked.drop("__n").join(stored, "item_id", "left_anti")


def _scale(value: Column, ratio: float) -> Column:
    return F.floor(F.log(value) / F.lit(math.log(1 / ratio))).cast("int")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


#: Blocks up to which those of an image all meet; in larger images they meet in a grid.
FEW_BLOCKS = 64


def joinable_blocks(blocks: DataFrame, carry: list[str] = []) -> DataFrame:
    """Block pairs that continue one line or stand above each other, ``pos_a`` before ``pos_b``.

    ``blocks``: image_id, variant, pos, box, confidence; ``carry`` names columns returned in the
    structs ``first`` and ``second``, left before right and upper before lower. Blocks move once, by
    image, and those of an image with up to FEW_BLOCKS all meet there. In larger images only blocks
    whose facing edges fall in neighbouring cells of a grid scaled by their size meet, each candidate
    pair in one cell of its kind; no such image is joined with itself.
    """
    keys = ["image_id", "variant"]
    boxed = blocks.where(F.col("box").isNotNull() & F.col("image_id").isNotNull() & F.col("variant").isNotNull())
    # Only images with many blocks have a row here.
    crowded = boxed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > FEW_BLOCKS).select(*keys)
    few, many = (_sized_boxes(boxed.join(crowded, keys, how), carry) for how in ("left_anti", "left_semi"))
    together = _side(few, "l", carry).join(_side(few, "r", carry), keys).where(_line_test() | _stack_test())
    cells = [*keys, "__cell"]
    left = _side(many.withColumn("__cell", F.explode(_cells(_line_ends, _stack_bottoms))), "l", carry)
    right = _side(many.withColumn("__cell", F.explode(_cells(_line_starts, _stack_tops))), "r", carry)
    kind = F.col("__cell.kind")
    apart = left.join(right, cells).where(
        F.when(kind == "line", _line_test()).otherwise(_stack_test()))
    structs = [F.struct(*[F.col(f"{t}_{c}").alias(c) for c in carry]).alias(n) for t, n in (("l", "first"), ("r", "second"))]
    return together.unionByName(apart.drop("__cell")).select(
        *keys, F.least("l_pos", "r_pos").alias("pos_a"), F.greatest("l_pos", "r_pos").alias("pos_b"),
        F.when(_line_test(), "line").otherwise("stack").alias("layout"), *(structs if carry else []))


EDGES = ["min_x", "min_y", "max_x", "max_y"]
SIDE = ["pos", "confidence", "h", "w", "cx", *EDGES]


def _sized_boxes(blocks: DataFrame, carry: list[str]) -> DataFrame:
    boxed = blocks.where(F.col("box").isNotNull()).select(
        "image_id", "variant", "pos", "confidence", *[F.col(f"box.{e}").alias(e) for e in EDGES],
        N.box_height(F.col("box")).alias("h"), *[F.col(c).alias(f"__{c}") for c in carry],
    )
    return boxed.withColumns({
        "w": F.col("max_x") - F.col("min_x"), "cy": (F.col("min_y") + F.col("max_y")) / 2,
        "cx": (F.col("min_x") + F.col("max_x")) / 2,
    }).withColumns({
        "hc": _scale(F.col("h"), 0.6), "wc": F.when((F.col("confidence") >= 0.75) & (F.col("w") > 0), _scale(F.col("w"), 0.65)),
    })


def _side(df: DataFrame, tag: str, carry: list[str]) -> DataFrame:
    return df.select(
        "image_id", "variant", *[c for c in ["__cell"] if c in df.columns],
        *[F.col(c).alias(f"{tag}_{c}") for c in SIDE if c not in carry], *[F.col(f"__{c}").alias(f"{tag}_{c}") for c in carry])


def _cell_struct(kind: str, hk: Column, wk: Column, yk: Column, xk: Column) -> Column:
    named = {"hk": hk, "wk": wk, "yk": yk, "xk": xk}
    return F.struct(F.lit(kind).alias("kind"), *[c.cast("long").alias(n) for n, c in named.items()])


def _cells(line, stack) -> Column:
    """Grid cells of a block, by scale; only confident blocks with a width can stand in a stack."""
    return F.when(F.col("wc").isNull(), F.array(*line())).otherwise(F.array(*line(), *stack()))


# The scale class ``hk`` belongs to the right or lower block: facing blocks are at most one class
# apart, so neither is taller than ``_reach``, which is also the side of a cell.
def _reach(hk: Column) -> Column:
    return F.pow(F.lit(1 / 0.6), hk + 2)


def _offset(wk: Column) -> Column:
    return F.pow(F.lit(1 / 0.65), wk + 1) * 0.25


def _line_ends() -> list[Column]:
    return [
        _cell_struct("line", hk, F.lit(0), _cell(F.col("cy"), _reach(hk)), _cell(F.col("max_x"), _reach(hk)))
        for hk in (F.col("hc") + d for d in (-1, 0, 1))
    ]


def _line_starts() -> list[Column]:
    hk = F.col("hc")
    y, x = _cell(F.col("cy"), _reach(hk)), _cell(F.col("min_x"), _reach(hk))
    return [_cell_struct("line", hk, F.lit(0), y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0)]


def _stack_bottoms() -> list[Column]:
    return [
        _cell_struct("stack", hk, wk, _cell(F.col("max_y"), _reach(hk)), _cell(F.col("cx"), _offset(wk)))
        for hk in (F.col("hc") + d for d in (-1, 0, 1)) for wk in (F.col("wc") + d for d in (-1, 0, 1))
    ]


def _stack_tops() -> list[Column]:
    hk, wk = F.col("hc"), F.col("wc")
    y, x = _cell(F.col("min_y"), _reach(hk)), _cell(F.col("cx"), _offset(wk))
    return [_cell_struct("stack", hk, wk, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _line_test() -> Column:
    """``l`` ends where ``r`` begins on the same line."""
    small, large = F.least("l_h", "r_h"), F.greatest("l_h", "r_h")
    gap = F.col("r_min_x") - F.col("l_max_x")
    return _alike() & (_overlap_y() >= small * 0.4) & gap.between(F.lit(0.0), large)


def _stack_test() -> Column:
    """``l`` stands above ``r``, both confident and of like width and centre."""
    small, large = F.least("l_h", "r_h"), F.greatest("l_h", "r_h")
    narrow, broad = F.least("l_w", "r_w"), F.greatest("l_w", "r_w")
    above = (F.col("l_min_y") < F.col("r_min_y")) | (
        (F.col("l_min_y") == F.col("r_min_y")) & (F.col("l_pos") < F.col("r_pos")))
    gap = F.col("r_min_y") - F.col("l_max_y")
    overlap_x = F.least("l_max_x", "r_max_x") - F.greatest("l_min_x", "r_min_x")
    return (
        _alike() & above & (F.least("l_confidence", "r_confidence") >= 0.75)
        & F.col("l_confidence").isNotNull() & F.col("r_confidence").isNotNull() & (narrow > 0)
        & (_overlap_y() < small * 0.4) & (narrow / broad >= 0.65) & (F.abs(F.col("l_cx") - F.col("r_cx")) <= narrow * 0.25)
        & gap.between(large * -0.25, large * 0.75) & (overlap_x >= narrow * 0.4)
    )


def _alike() -> Column:
    return (F.col("l_pos") != F.col("r_pos")) & (F.least("l_h", "r_h") / F.greatest("l_h", "r_h") >= 0.6)


def _overlap_y() -> Column:
    return F.least("l_max_y", "r_max_y") - F.greatest("l_min_y", "r_min_y")
