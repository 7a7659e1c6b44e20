"""Near-duplicates by SimHash fingerprints and pigeonhole blocks (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import saved, table
from shelfmatch.llm.components import connected

BITS = 64
#: Fingerprints in a bucket up to which its pairs are compared directly.
DIRECT = 64


def fingerprint(data: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of UTF-8 text: a bit is 1 if set in over half of the shingle hashes."""
    parts = (data or b"").lower().split()
    if not parts:
        return 0
    if len(parts) < size:
        shingles, n = [b" ".join(parts)], 1
    else:
        n = len(parts) - size + 1
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(size))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        octets = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(rows: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """All columns but the last, which is the text, and its fingerprint ``__fp``."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            found = [fingerprint(texts[i].as_py(), size, seed) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.int64())], names=[*kept, "__fp"]
            )

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__fp", T.LongType())])
    return rows.withColumn(rows.columns[-1], F.col(rows.columns[-1]).cast("binary")).mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask per choice of ``blocks - distance`` blocks: a close pair agrees on at least one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(single, blocks - distance)]


def close_pairs(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Links between distinct fingerprints (column ``__fp``) that connect all within ``distance`` bits.

    Buckets of up to DIRECT fingerprints are joined on the block value and verified by Hamming
    distance, so every pair is found. Fingerprints of larger buckets meet at a common middle
    instead: two values within 2 bits have a value within 1 bit of both. Each sends its 65
    neighbours, a neighbour gathers 65 at most, and all who meet there are linked to the smallest.
    That needs ``65 n`` rows where pairs would need ``n * n``, and connects the same values.
    For other distances, larger buckets are joined as the small ones are.
    """
    masks = block_masks(distance, blocks)
    keyed = saved(prints.select("__fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("__fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)
    ])).alias("__k")).select("__fp", "__k.c", "__k.v"))
    sizes = keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    grouped = keyed.join(sizes, ["c", "v"])
    small = grouped.where(F.col("__n") <= DIRECT) if distance == 2 else grouped
    left, right = small.select("c", "v", F.col("__fp").alias("a")), small.select("c", "v", F.col("__fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    links = left.join(right, ["c", "v"]).where(near).select("a", "b")
    if distance != 2:
        return links.distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    hot = grouped.where(F.col("__n") > DIRECT).select("__fp").distinct()
    middles = hot.select("__fp", F.explode(flips).alias("__flip")).select(
        "__fp", F.col("__fp").bitwiseXOR(F.col("__flip")).alias("__middle")
    )
    met = middles.groupBy("__middle").agg(F.collect_list("__fp").alias("__all")).where(F.size("__all") > 1)
    stars = met.select(F.array_min("__all").alias("a"), F.explode("__all").alias("b")).where("a <> b")
    return links.union(stars).distinct()


def smallest_linked(rows: DataFrame, order: Column, distance: int, blocks: int) -> DataFrame:
    """Per fingerprint of ``rows``: ``__fp`` and ``__component``, the smallest ``order`` reachable."""
    prints = saved(rows.groupBy("__fp").agg(F.min(order).alias("__first")))
    roots = connected(close_pairs(prints, distance, blocks))
    linked = prints.join(roots, prints["__fp"] == roots["node"]).select("__fp", "root", "__first")
    least = linked.groupBy("root").agg(F.min("__first").alias("__least"))
    found = linked.join(least, "root").select("__fp", "__least")
    return prints.join(found, "__fp", "left").select("__fp", F.coalesce("__least", "__first").alias("__component"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
    distance: int = 2, blocks: int = 4,
) -> DataFrame:
    """Link rows whose fingerprints differ in at most ``distance`` bits, and follow the links.

    Rows with equal fingerprints are combined first, so copies are never expanded into pairs.
    Returns one row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest identifier reachable. Null and blank texts have fingerprint zero and are linked like
    any other. Null identifiers are never the smallest unless their whole component has none;
    repeated rows give repeated answers. Other columns are not read.
    """
    rows = saved(fingerprints(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), size, seed))
    answers = smallest_linked(rows, F.col("__id"), distance, blocks)
    return rows.join(answers, "__fp").select(
        F.col("__id").alias("doc_id"),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"),
    )


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42,
    distance: int = 2, blocks: int = 4,
) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each group of near-duplicates.

    The smallest identifier stays; null identifiers come last and are told apart by their text. Of
    rows that repeat identifier and text, one stays.
    """
    keys = ["__null", "__id", "__hash"]
    kind = df.schema[id_col].dataType
    keyed = df.withColumns({
        "__null": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0).cast(kind)),
        "__hash": F.xxhash64(text_col),
    })
    rows = saved(fingerprints(keyed.select(*keys, F.col(text_col).alias("__text")), size, seed))
    stay = smallest_linked(rows, F.struct(*keys), distance, blocks).select("__component.*").distinct()
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*df.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
