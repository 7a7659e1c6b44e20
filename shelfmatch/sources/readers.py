"""Readers of manifests, catalogs, sample lists, image trees and review runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch import constants as K
from shelfmatch.functions import text as X
from shelfmatch.sources.csv_records import header_and_rows, numbered_records

BENCHMARK_SCHEMA = (
    "sample_id string, image string, series_id string, split string, conditions array<string>, catalog_id string, "
    "truth struct<full_text:string,name:string,producer:string,year:string>, "
    "annotations struct<label_bbox:array<int>,bottle_bbox:array<int>,bottle_mask:string,"
    "cylinder:struct<cx:double,radius:double,theta_min:double,theta_max:double>>"
)
ANNOTATION_SCHEMA = (
    "image string, annotations struct<label_bbox:array<int>,bottle_bbox:array<int>,bottle_mask:string,"
    "cylinder:struct<cx:double,radius:double,theta_min:double,theta_max:double>>"
)
OCR_RESULT_SCHEMA = (
    "result struct<normalized_text:string,candidate_name:string,"
    "text_blocks:array<struct<text:string,normalized_text:string,confidence:double,"
    "bbox:struct<points:array<struct<x:double,y:double>>>,source_variant:string>>,"
    "candidate_fields:array<struct<field_type:string,value:string,normalized_value:string,source_text:string,"
    "confidence:double>>>"
)
RUN_MANIFEST_SCHEMA = "images array<struct<image:string,source:string,elapsed_seconds:double>>"


def read_manifest_csv(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required cell filled, and problem rows; both carry physical line numbers."""
    return manifest_rows(*header_and_rows(spark, path), required)


def manifest_rows(header: list[str], rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """As ``read_manifest_csv`` over parsed records: line, unclosed, cells."""
    names = [h.strip() for h in header]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; found: {', '.join(names)}")
    repeated = [c for c in required if names.count(c) > 1]
    if repeated:
        raise ValueError(f"repeated columns: {', '.join(repeated)}")
    cell = lambda i: F.coalesce(X.clean_value(F.get("cells", F.lit(i))), F.lit(""))
    width = len(header)
    filled = F.exists("cells", lambda c: X.clean_value(c).isNotNull())
    picked = rows.where(filled).select(
        "line", "unclosed", F.size("cells").alias("n"), *[cell(names.index(c)).alias(c) for c in required]
    )
    empty = F.concat_ws(", ", *[F.when(F.col(c) == "", F.lit(c)) for c in required])
    problem = F.when(F.col("unclosed"), "unclosed quote").when(
        F.col("n") > width, F.concat(F.col("n").cast("string"), F.lit(f" values for {width} columns"))
    ).when(empty != "", F.concat(F.lit("empty "), empty))
    checked = picked.withColumn("problem", problem)
    good = checked.where("problem is null").select("line", *required)
    return good, checked.where("problem is not null").select("line", "problem")


def resolve_aliases(headers: list[str], aliases: dict[str, list[str]] = K.FIELD_ALIASES) -> dict[str, int | None]:
    """Position of every canonical field in the header; the first known alias wins."""
    position = {h.strip().casefold(): i for i, h in enumerate(headers)}
    found = {
        field: next((position[a.casefold()] for a in names if a.casefold() in position), None)
        for field, names in aliases.items()
    }
    for field in ("slug", "dataset_photo"):
        if field in aliases and found[field] is None:
            raise ValueError(f"the catalog needs a column for {field}: one of {', '.join(aliases[field])}")
    return found


def read_catalog_csv(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Catalog rows with aliased headers, the whole source row as a map, and record numbers from 2."""
    return catalog_rows(*header_and_rows(spark, path), source_id)


def catalog_rows(header: list[str], rows: DataFrame, source_id: str) -> DataFrame:
    """As ``read_catalog_csv`` over parsed records: file, start_line, value, cells."""
    fields = resolve_aliases(header)
    last = {h: i for i, h in enumerate(header)}
    width = len(header)
    cell = lambda i: F.get("cells", F.lit(i))
    source = F.map_from_arrays(F.array(*[F.lit(h) for h in last]), F.array(*[cell(i) for i in last.values()]))
    extras = F.to_json(F.slice("cells", width + 1, F.greatest(F.size("cells") - width, F.lit(1))))
    with_extras = F.when(
        F.size("cells") > width, F.map_concat(source, F.create_map(F.lit("_extra_columns"), extras))
    ).otherwise(source)
    value = lambda i: X.clean_value(cell(i)) if i is not None else F.lit(None).cast("string")
    return numbered_records(rows).select(
        *[value(i).alias(f) for f, i in fields.items()], with_extras.alias("source_data"),
        F.lit(source_id).alias("import_source"), (F.col("record") + 1).alias("source_row_number"),
    )


def read_jsonl(
    spark: SparkSession, path: str, schema: str, required: list[str], unique: str, safe_name: bool = False
) -> tuple[DataFrame, DataFrame]:
    """JSON-lines rows and problem rows: broken lines, missing fields, repeated keys, unsafe ids."""
    full = T.StructType(T._parse_datatype_string(schema).fields + [T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_broken").json(path)
    key = F.col(unique)
    blank = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required]
    counts = rows.where(key.isNotNull()).groupBy(unique).agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(counts, unique, "left")
    unsafe = key.rlike(r"/") | key.isin(".", "..") if safe_name else F.lit(False)
    missing = F.concat_ws(", ", *blank)
    problem = (
        F.when(F.col("_broken").isNotNull(), "not a JSON object of this schema")
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .when(F.coalesce(unsafe, F.lit(False)), "unsafe name").when(F.col("__n") > 1, "repeated key")
    )
    checked = joined.withColumn("problem", problem)
    columns = [c for c in rows.columns if c != "_broken"]
    return checked.where("problem is null").select(*columns), checked.where("problem is not null").select(
        unique, "_broken", "problem"
    )


def _plain_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_plain_path(F.col("path")).alias("path"), "length")


def scan_image_tree(spark: SparkSession, root: str, suffixes: list[str] = K.UPLOAD_SUFFIXES) -> DataFrame:
    """(item_id, slug, image_uri) of ``<root>/<item>/<photo>`` and ``<root>/<photo>``."""
    base = root.rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.lit(len(base) + 1))
    parts = F.split("rel", "/")
    item = F.when(F.size(parts) == 2, parts[0]).otherwise(X.file_stem(F.col("rel")))
    return scan_files(spark, root).select("path", relative.alias("rel")).where(
        (F.size(parts) <= 2) & ~F.col("rel").rlike(r"(^|/)\.") & X.file_suffix(F.col("rel")).isin(suffixes)
    ).select(item.alias("item_id"), item.alias("slug"), F.col("path").alias("image_uri"))


def parse_truth_blocks(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``imageN: {name, years, other}`` entries as rows, and problem rows."""
    entry = r"image(\d+)\s*:\s*\{([^}]*)\}"
    blocks = texts.select(F.explode(F.regexp_extract_all(column, F.lit(entry), F.lit(0))).alias("b"))
    body = F.regexp_extract("b", entry, 2)
    field = lambda f: F.try_element_at(F.regexp_extract_all(body, F.lit(f'{f}\\s*:\\s*"([^"]*)"'), F.lit(1)), F.lit(-1))
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(
        F.regexp_extract("b", entry, 1).try_cast("long").alias("image_no"), F.trim(field("name")).alias("name"),
        listed(field("years")).alias("years"), listed(field("other")).alias("other"), field("other").isNull().alias("__bare"),
    )
    counts = rows.groupBy("image_no").agg(F.count(F.lit(1)).alias("__n"))
    checked = rows.join(counts, "image_no").withColumn(
        "problem", F.when(F.col("__n") > 1, "duplicate entry").when(
            (F.coalesce("name", F.lit("")) == "") | F.col("__bare"), "entry needs name and other"),
    ).drop("__n", "__bare")
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null").select("image_no", "problem")


def read_truth_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_truth_blocks(spark.read.text(path, wholetext=True))


def read_review_run(spark: SparkSession, run_dir: str, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review images with truth and saved result, and problem rows for images missing either."""
    manifest = spark.read.schema(RUN_MANIFEST_SCHEMA).option("multiLine", "true").json(f"{run_dir}/manifest.json")
    images = manifest.select(F.posexplode("images").alias("position", "i")).select(
        F.regexp_extract("i.image", r"^image(\d+)\.[^.]+$", 1).try_cast("long").alias("image_no"), F.col("position").cast("long"),
        F.col("i.image").alias("image"), F.col("i.source").alias("source"), F.col("i.elapsed_seconds").alias("elapsed_seconds"),
    )
    outputs = spark.read.schema(OCR_RESULT_SCHEMA).option("multiLine", "true").json(f"{run_dir}/image*_output.json").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^image(\d+)_output\.json$", 1).try_cast("long").alias("image_no"), "result.*"
    )
    known = images.where("image_no is not null")
    good = known.join(truth, "image_no").join(outputs, "image_no")
    problems = [
        images.where("image_no is null").select(F.col("image").alias("subject"), F.lit("unexpected image name").alias("problem")),
        known.join(truth, "image_no", "left_anti").select(F.col("image").alias("subject"), F.lit("missing truth").alias("problem")),
        known.join(outputs, "image_no", "left_anti").select(F.col("image").alias("subject"), F.lit("missing result").alias("problem")),
        truth.join(known, "image_no", "left_anti").select(
            F.concat(F.lit("image"), "image_no").alias("subject"), F.lit("truth without image").alias("problem")),
    ]
    return good, reduce(DataFrame.unionByName, problems)


def read_matched_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_photo, relative_path) of matched rows."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.where("status = 'matched' and coalesce(relative_path, '') <> ''").select("dataset_photo", "relative_path")
