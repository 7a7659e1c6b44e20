"""Hooks for models: batch functions that users supply, run next to the data.

A hook gets a whole Arrow batch. When a batch fails, its rows are tried one by one, and a row that
fails alone becomes a row with an error; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.constants import MAX_ERROR_CHARS
from shelfmatch.skew import first_per_key

BatchFunction = Callable[[pd.DataFrame], Sequence]


def _run(batch: pd.DataFrame, function: BatchFunction) -> tuple[list, list]:
    try:
        out = list(function(batch))
        if len(out) != len(batch):
            raise ValueError("model returned an unexpected number of results")
        return out, [None] * len(batch)
    except Exception as batch_error:
        if len(batch) == 1:
            return [None], [f"{type(batch_error).__name__}: {batch_error}"[:MAX_ERROR_CHARS]]
    results, errors = [], []
    for i in range(len(batch)):
        out, err = _run(batch.iloc[i : i + 1], function)
        results += out
        errors += err
    return results, errors


def _apply(df: DataFrame, factory: Callable[[], BatchFunction], result: T.StructField, batch_size: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, result, T.StructField("error", T.StringType())])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = factory()  # one model per task
        for part in parts:
            for begin in range(0, len(part), batch_size):
                piece = part.iloc[begin : begin + batch_size].reset_index(drop=True)
                out, errors = _run(piece, function)
                piece[result.name] = pd.Series(out, dtype=object, index=piece.index)
                piece["error"] = pd.Series(errors, dtype=object, index=piece.index)
                yield piece

    return df.mapInPandas(batches, schema)


def embed(
    df: DataFrame, factory: Callable[[], BatchFunction], model_name: str, batch_size: int = 16,
    same_input: str | None = None,
) -> DataFrame:
    """Adds embedding, model_name and error. Rows with equal ``same_input`` are embedded once."""
    field = T.StructField("embedding", T.ArrayType(T.DoubleType()))
    if same_input is None:
        return _apply(df, factory, field, batch_size).withColumn("model_name", F.lit(model_name))
    once = first_per_key(df, [same_input], [F.xxhash64(*[c for c in df.columns if c != same_input])])
    done = _apply(once, factory, field, batch_size).select(same_input, "embedding", "error")
    return df.join(done, same_input, "left").withColumn("model_name", F.lit(model_name))


BLOCK_TYPE = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.StructType([
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
]))


def recognize_text(images: DataFrame, factory: Callable[[], BatchFunction], batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Blocks of recognised text in the coordinates of the original image, and failed images.

    ``images``: image_id, variant, origin_x, origin_y and what the engine reads.
    """
    from shelfmatch.functions.vectors import box_of, box_translate

    read = _apply(images, factory, T.StructField("blocks", BLOCK_TYPE), batch_size)
    rows = read.where("error is null").select(
        "image_id", "variant", "origin_x", "origin_y", F.posexplode("blocks").alias("n", "b"))
    blocks = rows.select(
        "image_id", "variant", F.col("n").cast("long").alias("seq"), "b.text", "b.confidence",
        box_translate(box_of(F.col("b.bbox")), F.col("origin_x"), F.col("origin_y")).alias("box"),
    )
    return blocks, read.where("error is not null").select("image_id", "variant", "error")


PAIR_TYPE = T.StructType([
    T.StructField("matches", T.IntegerType()), T.StructField("inliers", T.IntegerType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
])


def match_photos(pairs: DataFrame, factory: Callable[[], BatchFunction], batch_size: int = 8) -> DataFrame:
    """Adds matches, inliers, mean_match_score and error to candidate photo pairs."""
    from shelfmatch.functions.vectors import mean_match_score

    out = _apply(pairs, factory, T.StructField("__stats", PAIR_TYPE), batch_size)
    return out.select(
        *pairs.columns, "__stats.matches", "__stats.inliers",
        mean_match_score(F.coalesce("__stats.scores", F.array().cast("array<double>"))).alias("mean_match_score"), "error",
    )


PREDICTION_TYPE = T.StructType([
    T.StructField(f, T.StringType()) for f in ("full_text", "name", "producer", "year")
])


def predict_variants(samples: DataFrame, factory: Callable[[], BatchFunction], batch_size: int = 8) -> DataFrame:
    """Adds the recognised fields of every (sample, variant) image; failed rows have status failed."""
    out = _apply(samples, factory, T.StructField("prediction", PREDICTION_TYPE), batch_size)
    return out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
