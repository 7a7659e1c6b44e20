"""Exports and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exportable_feedback(feedback: DataFrame, samples: DataFrame, approved_only: bool = False) -> DataFrame:
    """Labelled, not rejected votes with their verified photo; a wrong digest fails the export."""
    status = F.col("review_status")
    chosen = feedback.where(F.col("correct_slug").isNotNull() & (status != "rejected"))
    if approved_only:
        chosen = chosen.where(status == "approved")
    stored = samples.select(
        "image_sha256",
        F.when(F.sha2("image_bytes", 256) == F.col("image_sha256"), _image_suffix(F.col("image_bytes"))).otherwise(
            F.raise_error(F.concat(F.lit("Stored sample hash mismatch: "), "image_sha256"))).alias("suffix"),
    )
    return chosen.join(stored, "image_sha256").select(
        "job_id", F.concat("image_sha256", "suffix").alias("image_path"), "image_sha256", "predicted_slug",
        "correct_slug", "review_status", "created_at",
    )


def _image_suffix(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), ".jpg").when(head.startswith("89504E47"), ".png")
        .when(head.startswith("52494646") & head.endswith("57454250"), ".webp").otherwise("")
    )


def export_feedback_jsonl(feedback: DataFrame, samples: DataFrame, out: str, approved_only: bool = False) -> None:
    """Ordered JSON lines; an existing export is never overwritten."""
    rows = exportable_feedback(feedback, samples, approved_only)
    rows.orderBy("created_at", "job_id").drop("created_at").write.mode("errorifexists").json(out)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in name order at the top level and in nested structs."""
    return df.select(F.to_json(_sorted_struct(df)).alias("value"))


def _sorted_struct(df: DataFrame) -> Column:
    from pyspark.sql import types as T

    def shape(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*[shape(c[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.transform(c, lambda e: shape(e, t.elementType))
        return c

    return F.struct(*[shape(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])


def write_report_json(df: DataFrame, path: str) -> None:
    report_json(df).write.mode("errorifexists").text(path)


SECTIONS = {"name": "Candidate name", "year": "Candidate years", "percentage": "Candidate percentages", "volume": "Candidate volumes"}


def _shown_confidence(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.3f", c))


def render_text_report(
    images: DataFrame, blocks: DataFrame, fields: DataFrame, title: str = "Text Recognition Report"
) -> DataFrame:
    """Report lines (image_id, section, item, line); in this order they form one report per image.

    ``images``: image_id, engine, processing_time_ms, warnings, normalized_text; ``blocks``:
    image_id, pos, text, confidence, variant; ``fields``: image_id, field_type, value,
    normalized_value, confidence, field_no, variant. Lines stay rows, so that an image with any
    number of blocks can be written; writers sort by (image_id, section, item).
    """
    section = lambda df, no, item, line: df.select(
        "image_id", F.lit(no).alias("section"), item.cast("long").alias("item"), line.alias("line"))

    def fixed(no: int, *lines: Column) -> DataFrame:
        shown = F.filter(F.array(*lines), lambda x: x.isNotNull())
        return images.select("image_id", F.lit(no).alias("section"), F.posexplode(shown).alias("item", "line")).withColumn(
            "item", F.col("item").cast("long"))

    lit = lambda s: F.lit(s)
    parts = [
        fixed(
            0, lit(title), lit("=" * len(title)), lit(""), F.concat(lit("Engine: "), "engine"),
            F.concat(lit("Processing time, ms: "), F.format_string("%.2f", "processing_time_ms")),
            F.when(F.size("warnings") > 0, F.concat(lit("Warnings: "), F.array_join("warnings", "; "))), lit(""),
            lit("Raw lines"), lit("---------"),
        ),
        section(blocks, 1, F.col("pos"), F.concat(
            lit("- "), "text", lit(" [confidence: "), _shown_confidence(F.col("confidence")), lit(", "), "variant", lit("]"))),
        section(images.join(blocks, "image_id", "left_anti"), 1, lit(0), lit("(no text recognized)")),
        fixed(2, lit(""), lit("Normalized text"), lit("---------------"),
              F.coalesce(F.nullif(F.col("normalized_text"), lit("")), lit("(empty)")), lit("")),
    ]
    conf = _shown_confidence(F.col("confidence"))
    for n, (kind, heading) in enumerate(SECTIONS.items()):
        mine = fields.where(F.col("field_type") == kind)
        base = 3 + 3 * n
        if kind == "name":
            line = F.concat(lit("- "), "value", lit(" (OCR confidence: "), conf, lit(", source: "),
                            F.coalesce("variant", lit("unknown")), lit(")"))
        else:
            line = F.concat(lit("- "), "normalized_value", lit(" (raw: "), "value", lit(", confidence: "), conf, lit(")"))
        parts += [
            fixed(base, lit(heading), lit("-" * len(heading))), section(mine, base + 1, F.col("field_no"), line),
            section(images.join(mine, "image_id", "left_anti"), base + 1, lit(0), lit("(none)")), fixed(base + 2, lit("")),
        ]
    return reduce(DataFrame.unionByName, parts)


def write_text_reports(lines: DataFrame, path: str) -> None:
    """One folder per image; its lines are in order within the sorted part files."""
    lines.repartitionByRange("image_id", "section", "item").sortWithinPartitions("image_id", "section", "item").select(
        "image_id", "line"
    ).write.mode("errorifexists").partitionBy("image_id").text(path)
