"""Recognised text blocks of a photo: duplicates, fields, names and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.functions import vectors as N
from shelfmatch.operators.joins import joinable_blocks
from shelfmatch.operators.ranking import reading_key, reading_order
from shelfmatch.session import cut_lineage
from shelfmatch.skew import first_per_key

BLOCK_IOU = 0.6


def build_blocks(raw: DataFrame) -> DataFrame:
    """Normalized, non-empty blocks in reading order without duplicates."""
    normal = raw.withColumn("normalized_text", X.normalize_text(F.col("text"))).where("normalized_text <> ''")
    return duplicate_blocks(cut_lineage(reading_order(normal)))


GROUP = ["image_id", "normalized_text"]


#: Blocks of one text up to which a photo's are folded where they meet; more of them are swept for connected groups.
FEW_COPIES = 64


def duplicate_blocks(blocks: DataFrame, iou: float = BLOCK_IOU, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drop blocks of equal text that overlap, keeping the more confident one in the first place.

    A block alone with its text meets nothing and stays as it is; digests of image and text, counted
    first, tell which. The others move by image and text: up to FEW_COPIES of them are folded in order
    where they meet, and larger groups are swept (``_without_copies``). Digests that are equal by chance
    only send blocks the longer way. Blocks without ``pos`` are taken in reading order, and ``order`` numbers
    those of larger groups; the result has no ``pos`` either. ``blocks`` is read three times.
    """
    digest = F.xxhash64(*GROUP).alias("__digest")
    shared = cut_lineage(blocks.groupBy(digest).count().where("count > 1"))
    crowded = shared.where(F.col("count") > FEW_COPIES)
    chosen = lambda digests, how: blocks.select("*", digest).join(digests.select("__digest"), "__digest", how).select(*blocks.columns)
    place = reading_key() if order else F.col("pos")
    few = chosen(shared.where(F.col("count") <= FEW_COPIES), "left_semi").withColumn("first_pos", place)
    kept = chosen(shared, "left_anti").unionByName(_fold(few, GROUP, ["first_pos", *blocks.columns], iou).drop("first_pos"))
    if crowded.isEmpty():
        return kept
    many = cut_lineage(chosen(crowded, "left_semi"))
    many = cut_lineage(order(many)) if order else many
    return kept.unionByName(_without_copies(many, iou).select(*blocks.columns))


def _without_copies(blocks: DataFrame, iou: float) -> DataFrame:
    """``duplicate_blocks`` of numbered blocks, however many share their text.

    The rule depends on order, and a kept block may be replaced before the next one is compared. It
    only ever compares blocks of equal text in one photo that overlap, so the unit of work is a
    connected group of overlapping boxes, found by a sweep down and a sweep across (``connected_runs``):

    * Equal boxes that follow each other act as the most confident of them in the first one's place.
    * A box without area overlaps nothing, not even its copies: it always stays.
    * Blocks without a box come last and match the first block kept, so the most confident of them,
      first on ties, stands for all and meets that block alone.
    """
    columns = blocks.columns
    width, height = F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y")
    area = F.coalesce((width > 0) & (height > 0), F.lit(False))
    sure = -F.coalesce("confidence", F.lit(-1.0))
    best = F.min_by(F.struct(*columns), F.struct(sure, F.col("pos")))

    boxed = blocks.where(area)
    corner = [*GROUP, "__x", "__y"]
    cornered = boxed.withColumns({"__x": F.col("box.min_x"), "__y": F.col("box.min_y")})
    corners = cornered.groupBy(*corner).agg(
        best.alias("row"), F.min("pos").alias("first_pos"), (F.min("box") == F.max("box")).alias("__one"))
    alike = corners.where("__one").select("first_pos", "row.*")
    named = corners.where(~F.col("__one")).select(*[F.col(c).alias(f"{c}_c") for c in corner])
    mixed = cornered.join(named, _same(corner, "_c"), "left_semi").select(F.col("pos").alias("first_pos"), *columns)
    work = cut_lineage(alike.unionByName(mixed))
    down = connected_runs(work, GROUP, F.col("box.min_y"), F.col("box.max_y"), F.floor(F.col("box.min_y") / 256), "__down")
    runs = connected_runs(down, [*GROUP, "__down"], F.col("box.min_x"), F.col("box.max_x"), F.floor(F.col("box.min_x") / 256), "__across")
    folded = _fold(runs, [*GROUP, "__down", "__across"], ["first_pos", *columns], iou)

    flat = blocks.where(F.col("box").isNotNull() & ~area).select(F.col("pos").alias("first_pos"), *columns)
    kept = cut_lineage(folded.unionByName(flat))
    unboxed = blocks.where("box is null").groupBy(*GROUP).agg(best.alias("__row"), F.min("pos").alias("__pos"))
    ahead = kept.groupBy(*[F.col(c).alias(f"{c}_k") for c in GROUP]).agg(F.min("first_pos").alias("__first"))
    last = unboxed.join(ahead, _same(GROUP, "_k"), "left")
    meets = last.where("__first is not null").select(*[F.col(c).alias(f"{c}_m") for c in GROUP], "__row", "__first")
    better = F.coalesce(F.coalesce("__row.confidence", F.lit(-1.0)) > F.coalesce("confidence", F.lit(-1.0)), F.lit(False))
    met = kept.join(meets, _same(GROUP, "_m") & (F.col("first_pos") == F.col("__first")), "left")
    whole = met.select(F.when(F.col("__row").isNotNull() & better, F.col("__row")).otherwise(F.struct(*columns)).alias("r")).select("r.*")
    return whole.unionByName(last.where("__first is null").select("__row.*").select(*columns))


def _same(columns: list[str], suffix: str) -> Column:
    both = F.lit(True)
    for c in columns:
        both = both & F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    return both


def connected_runs(df: DataFrame, keys: list[str], low: Column, high: Column, band: Column, name: str) -> DataFrame:
    """``df`` with the first (low, pos) of the run of touching intervals that each row belongs to.

    A sweep by (low, pos) begins a new run where an interval starts at or after the end of all before
    it. ``band`` never falls as ``low`` rises: a sweep is one window per band of a key, and what
    earlier bands reach is carried over from one row a band.
    """
    given = df.columns
    swept = df.withColumns({"__low": low, "__high": high, "__band": band, "__at": F.struct(low.alias("low"), F.col("pos").alias("pos"))})
    within = Window.partitionBy(*keys, "__band").orderBy("__at")
    swept = _with_carried(swept, keys, F.max("__high"), F.max("__high").over(within.rowsBetween(Window.unboundedPreceding, -1)), "__reach")
    begins = F.when(F.col("__reach").isNull() | (F.col("__low") >= F.col("__reach")), F.col("__at"))
    swept = cut_lineage(swept.withColumn("__begins", begins))
    swept = _with_carried(swept, keys, F.max("__begins"), F.max("__begins").over(within.rowsBetween(Window.unboundedPreceding, 0)), name)
    return cut_lineage(swept.select(*given, name))


def _with_carried(df: DataFrame, keys: list[str], whole: Column, local: Column, name: str) -> DataFrame:
    """The larger of a running value inside a band and the same of all bands before it."""
    group = [*keys, "__band"]
    before = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = df.groupBy(*group).agg(whole.alias("__all")).withColumn("__carried", F.max("__all").over(before)).select(
        *[F.col(k).alias(f"{k}_b") for k in group], "__carried")
    joined = df.withColumn("__local", local).join(bands, _same(group, "_b"), "left")
    return joined.select(*df.columns, F.greatest("__local", "__carried").alias(name))


def _fold(work: DataFrame, group: list[str], columns: list[str], iou: float) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    grouped = work.groupBy(*group).agg(rows.alias("rows"))
    folded = F.when(F.size("rows") == 1, F.col("rows")).otherwise(
        F.aggregate(F.slice("rows", 2, F.size("rows")), F.slice("rows", 1, 1), lambda kept, row: _place(kept, row, iou)))
    return grouped.select(F.explode(folded).alias("r")).select("r.*")


def _place(kept: Column, row: Column, iou: float) -> Column:
    """The kept blocks after one more block of the same text."""
    matches = F.transform(kept, lambda k: k["box"].isNull() | row["box"].isNull() | (N.box_iou(k["box"], row["box"]) >= iou))
    place = F.array_position(matches, True)
    sure = lambda r: F.coalesce(r["confidence"], F.lit(-1.0))
    replaced = F.transform(kept, lambda k, i: F.when(
        (i == place - 1) & (sure(row) > sure(k)), row.withField("first_pos", k["first_pos"])).otherwise(k))
    return F.when(place == 0, F.concat(kept, F.array(row))).otherwise(replaced)


def candidate_fields(blocks: DataFrame) -> DataFrame:
    """Years, percentages and volumes per image, each value with its most confident source.

    ``blocks``: image_id, pos, normalized_text, confidence. Equal confidences keep the first source;
    ``field_order`` is where the value first occurred.
    """
    text = F.col("normalized_text")
    plain = lambda kind, found: F.transform(found, lambda v: F.struct(
        F.lit(kind).alias("field_type"), v.alias("value"), v.alias("normalized_value")))
    pairs = lambda kind, found: F.transform(found, lambda v: F.struct(
        F.lit(kind).alias("field_type"), v["value"].alias("value"), v["normalized_value"].alias("normalized_value")))
    fields = F.concat(
        plain("year", X.extract_years(text)), pairs("percentage", X.extract_percentages(text)),
        pairs("volume", X.extract_volumes(text)),
    )
    found = blocks.where(text.rlike(r"\p{Nd}")).select(
        "image_id", "pos", "confidence", text.alias("source_text"), F.posexplode(fields).alias("n", "f")
    )
    order = F.struct("pos", "n")
    best = F.min_by(
        F.struct(F.col("f.value"), "confidence", "source_text"),
        F.struct(-F.coalesce("confidence", F.lit(-1.0)), order),
    )
    return found.groupBy("image_id", F.col("f.field_type"), F.col("f.normalized_value")).agg(
        best.alias("b"), F.min(order).alias("field_order")
    ).select("image_id", "field_type", "normalized_value", "b.*", "field_order")


def fields_of_text(images: DataFrame) -> DataFrame:
    """``candidate_fields`` input for images without blocks: the whole text as one source."""
    return images.where("normalized_text <> ''").select(
        "image_id", F.lit(0).cast("long").alias("pos"), "normalized_text",
        F.lit(None).cast("double").alias("confidence"),
    )


def vintage_evidence(fields: DataFrame) -> DataFrame:
    """Sorted distinct years per image, from confident lines that are not founding dates."""
    usable = (
        (F.col("field_type") == "year") & (F.col("confidence") >= 0.8)
        & F.col("value").rlike(r"^(19|20)\p{Nd}{2}$") & ~F.col("source_text").rlike(f"(?iu){K.FOUNDING_PATTERN}")
    )
    # At most two hundred distinct years exist.
    years = F.array_sort(F.collect_set(F.col("value").try_cast("int")))
    return fields.where(usable).groupBy("image_id").agg(years.alias("years"))


def candidate_name(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """The most name-like phrase of each image, from the central crop before the full photo.

    ``blocks``: image_id, variant, pos, text, box, confidence; ``images``: image_id, width. Of copies
    of a block, the first of the most confident ones stays, and less confident ones that come before all
    more confident ones: a pair scores by its less confident block, so that an earlier copy may lead on ties.
    """
    value = X.clean_name(F.col("text"))
    half = F.col("width") / 2
    cx = (F.col("box.min_x") + F.col("box.max_x")) / 2
    central = F.col("box").isNull() | (F.col("width") <= 0) | (F.abs(cx - half) <= F.col("width") * 0.25)
    plausible = blocks.where(
        F.col("variant").isin("central_crop", "full") & (F.col("confidence") >= 0.55)
    ).join(images, "image_id").where(central).withColumn("value", value).where("value <> ''")
    plausible = plausible.select(
        "image_id", "variant", "pos", "text", "value", "box", "confidence", "width",
        N.box_height(F.col("box")).alias("h"),
    )
    copies = ["image_id", "variant", "text", "box"]
    firsts = first_per_key(plausible, [*copies, "confidence"], [F.col("pos")])
    surer = Window.partitionBy(*copies).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = firsts.withColumn("__ahead", F.min("pos").over(surer))
    plausible = ahead.where(F.col("__ahead").isNull() | (F.col("pos") < F.col("__ahead"))).drop("__ahead")
    # One row per image tells which variant leads and which heights count in it.
    sure, tall = F.col("confidence") >= 0.7, F.col("h")
    in_variant = lambda v: F.col("variant") == v
    heights = plausible.groupBy("image_id").agg(*[
        F.max(F.when(in_variant(v) & s, tall)).alias(f"{v}_{n}")
        for v in ("central_crop", "full") for n, s in (("sure", sure), ("unsure", ~sure))
    ])
    leads = F.when(F.col("central_crop_sure").isNotNull(), "central_crop").otherwise("full")
    of_lead = lambda n: F.when(F.col("lead") == "central_crop", F.col(f"central_crop_{n}")).otherwise(F.col(f"full_{n}"))
    heights = heights.withColumn("lead", leads).select("image_id", "lead", of_lead("sure").alias("regular"), of_lead("unsure").alias("unsure"))
    rows = plausible.join(heights, "image_id").where((F.col("variant") == F.col("lead")) & (sure | (tall >= F.col("regular") * 3)))
    top = F.when(F.col("unsure") >= F.col("regular") * 3, F.greatest("unsure", "regular")).otherwise(F.col("regular"))
    # Singles and pairs both start from here; name-like blocks are few, so they are kept once.
    eligible = cut_lineage(rows.withColumn("max_h", top).drop("lead", "regular", "unsure"))

    option = ["image_id", "pos_a", "pos_b", "value", "source_text", "confidence", "box", "h", "width", "max_h"]
    singles = eligible.select(
        "image_id", F.col("pos").alias("pos_a"), F.lit(-1).cast("long").alias("pos_b"), "value",
        F.col("text").alias("source_text"), "confidence", "box", "h", "width", "max_h", "variant",
    )
    both = joinable_blocks(
        eligible.where(F.col("confidence") >= 0.75), ["text", "value", "box", "confidence", "h", "width", "max_h"])
    p, q = "first", "second"
    joint = lambda f, edge: f(f"{p}.box.{edge}", f"{q}.box.{edge}").alias(edge)
    pairs = both.select(
        "image_id", "pos_a", "pos_b", F.concat_ws(" ", f"{p}.value", f"{q}.value").alias("value"),
        F.concat_ws("\n", f"{p}.text", f"{q}.text").alias("source_text"),
        F.least(f"{p}.confidence", f"{q}.confidence").alias("confidence"),
        F.struct(joint(F.least, "min_x"), joint(F.least, "min_y"), joint(F.greatest, "max_x"), joint(F.greatest, "max_y")).alias("box"),
        F.least(f"{p}.h", f"{q}.h").alias("h"), F.col(f"{p}.width").alias("width"), F.col(f"{p}.max_h").alias("max_h"), "variant",
    )
    options = singles.select(*option, "variant").unionByName(pairs.select(*option, "variant"))
    scored = options.withColumn("name_score", _name_score())
    # Earlier options win ties: blocks in order before pairs in order.
    order = [
        -F.col("name_score"), F.when(F.col("pos_b") < 0, 0).otherwise(1), F.col("pos_a"), F.col("pos_b"),
    ]
    best = first_per_key(scored, ["image_id"], order)
    return best.select(
        "image_id", F.col("value").alias("name"), X.normalize_text(F.col("value")).alias("normalized_name"),
        "source_text", "confidence", "variant",
        F.when(F.col("pos_b") < 0, 1).otherwise(2).alias("block_count"), "name_score",
    )


def _name_score() -> Column:
    half = F.col("width") / 2
    cx = (F.col("box.min_x") + F.col("box.max_x")) / 2
    centre = F.when(F.col("box").isNull() | (F.col("width") <= 0), F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(cx - half) / half)
    )
    return (
        F.least(F.col("h") / F.col("max_h"), F.lit(1.0)) * 1.5 + centre * 1.5
        + F.coalesce("confidence", F.lit(0.5)) * 1.5
        + F.least(X.letter_count(F.col("value")) / 20, F.lit(1.0)) * 0.8
        + F.when(F.col("pos_b") >= 0, 0.8).otherwise(0.0)
    )
