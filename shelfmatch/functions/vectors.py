"""Column functions over vectors, scores, boxes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmatch import constants as K


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def l2_normalize(v: Column) -> Column:
    """Unit vector; NULL for a zero or non-finite vector."""
    norm = F.sqrt(dot(v, v))
    usable = (norm > 0) & F.forall(v, is_finite)
    return F.when(usable, F.transform(v, lambda x: x.cast("double") / norm))


def vector_problem(v: Column, model: Column, dim: int, expected_model: str) -> Column:
    """First reason a vector cannot be used, or NULL."""
    return (
        F.when(v.isNull(), "missing_vector")
        .when(~model.eqNullSafe(F.lit(expected_model)), "unexpected_model")
        .when(F.size(v) != dim, "unexpected_dimension")
        .when(~F.forall(v, lambda x: x.isNotNull() & is_finite(x)), "non_finite_vector")
        .when(~F.exists(v, lambda x: x != 0), "zero_vector")
    )


def rescale_similarity(distance: Column) -> Column:
    """1 - d/2 clamped to [0, 1]; NULL outside the cosine range."""
    similarity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - distance / 2))
    return F.when(is_finite(distance) & distance.between(-1e-6, 2 + 1e-6), similarity)


def histogram_similarity(a: Column, b: Column) -> Column:
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared))


def verify_decision(
    matches: Column, inliers: Column, min_matches: int = K.MIN_MATCHES,
    min_inliers: int = K.MIN_INLIERS, min_ratio: float = K.MIN_INLIER_RATIO,
) -> Column:
    """Struct (verified, inlier_ratio, valid)."""
    ratio = F.when(matches > 0, inliers / matches).otherwise(F.lit(0.0))
    valid = (matches >= 0) & (inliers >= 0) & (inliers <= matches)
    verified = valid & (matches >= min_matches) & (inliers >= min_inliers) & (ratio >= min_ratio)
    return F.struct(verified.alias("verified"), ratio.alias("inlier_ratio"), valid.alias("valid"))


def mean_match_score(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(scores) > 0, F.round(total / F.size(scores), 6)).otherwise(F.lit(0.0))


def box_of(points: Column) -> Column:
    """Axis-aligned extent of a polygon; NULL for a missing polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(points.isNotNull(), F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    ))


def box_translate(box: Column, dx: Column, dy: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(
        (box["min_x"] + dx).alias("min_x"), (box["min_y"] + dy).alias("min_y"),
        (box["max_x"] + dx).alias("max_x"), (box["max_y"] + dy).alias("max_y"),
    ))


def box_iou(a: Column, b: Column) -> Column:
    width = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    height = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])

    def area(x: Column) -> Column:
        return (x["max_x"] - x["min_x"]) * (x["max_y"] - x["min_y"])

    shared = width * height
    union = area(a) + area(b) - shared
    return F.when((width > 0) & (height > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def box_height(box: Column) -> Column:
    """Height of at least one pixel, also without a box."""
    return F.when(box.isNull(), F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), box["max_y"] - box["min_y"])
    )


def rgb_to_hsv(red: Column, green: Column, blue: Column) -> Column:
    """Hue, saturation and value in [0, 1] from channels in [0, 255]."""
    r, g, b = red / 255, green / 255, blue / 255
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = (
        F.when(span == 0, F.lit(0.0)).when(top == r, (g - b) / span)
        .when(top == g, F.lit(2.0) + (b - r) / span).otherwise(F.lit(4.0) + (r - g) / span)
    )
    hue = sector / 6 - F.floor(sector / 6)
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(span / top)
    return F.struct(hue.alias("h"), saturation.alias("s"), top.alias("v"))
