"""Document fingerprints by context-triggered piecewise hashing (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import saved, table

#: Bytes of the rolling window; chunks of a signature at most; smallest level (mean chunk 2 ** level bytes).
WINDOW, CHUNKS, LEAST = 7, 64, 2
#: Bytes hashed at once, so that memory follows the text at one byte in four.
STRIDE = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTORS = np.random.default_rng(13).integers(1, 1 << 31, WINDOW, np.uint32) * np.uint32(2) + np.uint32(1)


def triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at the smallest level, and the highest level at which each still ends a chunk.

    The rolling hash of a position depends on the last seven bytes alone. A chunk ends at level k
    where the hash has k trailing ones, so the ends of a level are among those of the level below.
    """
    ends, levels = [], []
    for at in range(0, len(data), STRIDE):
        from_ = max(0, at - WINDOW + 1)
        octets = np.frombuffer(data, np.uint8, min(len(data), at + STRIDE) - from_, from_).astype(np.uint32)
        rolled = octets * _FACTORS[0]
        for back in range(1, min(WINDOW, len(octets))):
            rolled[back:] += octets[:-back] * _FACTORS[back]
        rolled = rolled[at - from_ :]
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x2C1B3C6D)
        rolled ^= rolled >> np.uint32(13)
        mask = np.uint32((1 << LEAST) - 1)
        found = np.flatnonzero(rolled & mask == mask)
        hits = rolled[found]
        ends.append(found + at + 1)
        levels.append(np.bitwise_count((~hits & (hits + np.uint32(1))) - np.uint32(1)))
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(ends), np.concatenate(levels)


def signature(data: bytes, ends: list[int]) -> str:
    """A letter per chunk, from the hash of its bytes; what follows the last end is a chunk too."""
    letters, start = [], 0
    for end in ends:
        letters.append(LETTERS[xxhash.xxh64_intdigest(data[start:end]) & 63])
        start = end
    if start < len(data):
        letters.append(LETTERS[xxhash.xxh64_intdigest(data[start:]) & 63])
    return "".join(letters)


def fingerprint(data: bytes) -> str:
    """``level:signature:signature`` at the level and at the next, whose chunks are twice as long.

    The level is the smallest at which the whole text has at most 64 chunks, so signatures are never
    cut. An empty text has two empty signatures.
    """
    ends, levels = triggers(data)
    above = np.cumsum(np.bincount(levels, minlength=LEAST + 34)[::-1])[::-1]
    level = next(k for k in range(LEAST, len(above)) if above[k] < CHUNKS)
    one, two = (signature(data, ends[levels >= k].tolist()) for k in (level, level + 1))
    return f"{level}:{one}:{two}"


def edits(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is held as bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for letter in b:
        same = places.get(letter, 0)
        cross = (((same & up) + up) ^ up) | same
        rises, falls = down | ~(cross | up) & every, up & cross
        rises_last, falls_last = rises & last, falls & last
        distance += (rises_last > 0) - (falls_last > 0)
        rises, falls = rises << 1 | 1, falls << 1
        same |= down
        up, down = (falls | ~(same | rises)) & every, rises & same & every
    return distance


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, less by the share of letters to edit, 0 where no level is shared.

    Fingerprints of one level compare both signatures; of neighbouring levels, the two of the level
    that both have.
    """
    if a == b:
        return 1.0
    level_a, *of_a = a.split(":")
    level_b, *of_b = b.split(":")
    apart = int(level_a) - int(level_b)
    if abs(apart) > 1:
        return 0.0
    pairs = list(zip(of_a, of_b)) if not apart else [(of_a[0], of_b[1])] if apart == 1 else [(of_a[1], of_b[0])]
    longest = sum(max(len(x), len(y)) for x, y in pairs)
    return 1.0 - sum(edits(x, y) for x, y in pairs) / longest if longest else 1.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text.

    Null counts as empty. Equal texts have equal fingerprints, whatever their identifiers; those may
    be null or repeat. Other columns are not read. Memory of a task is a batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py() or b"") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def spliced(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``, or all."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


def compared(text: str, own: str, following: str, other: str) -> dict:
    """Fingerprints of a text and of its spliced form, and what they and the next text's have in common."""
    edited = spliced(text, following)
    data = edited.encode()
    changed = fingerprint(data)
    return {
        "n_chars": len(text), "edited_sha256": hashlib.sha256(data).hexdigest(), "fingerprint": own,
        "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, other),
    }


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def spliced_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How well fingerprints hold when the last third of each text gives way to the next text's start.

    The next row is that of the next smaller identifier; the last row is followed by the first. Null
    identifiers come last; rows that repeat an identifier follow each other by the hash of their
    text. Null texts count as empty. Every row gives one: ``doc_id`` and the columns of RESULT. Other columns
    are not read.

    Rows are dealt once into ranges of this order and sorted there. A task compares each row with
    the one after it, hashing every text once; a range's last row meets the first of the next range
    in a second step over two rows per range.
    """
    fields = [T.StructField("__id", df.schema[id_col].dataType), T.StructField("__part", T.IntegerType()),
              T.StructField("__edge", T.IntegerType()), T.StructField("__text", T.BinaryType()), *T.StructType.fromDDL(RESULT)]
    schema = T.StructType(fields)
    arrow = pa.schema([("__part", pa.int32()), ("__edge", pa.int32()), ("__text", pa.binary()), ("n_chars", pa.int64()),
                       *[(f.name, pa.string()) for f in fields[5:8]], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def decoded(text: pa.Scalar) -> str:
        return (text.as_py() or b"").decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, rows = [], []
            for i in range(batch.num_rows):
                one, part, text = batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), decoded(batch.column(2)[i])
                own = fingerprint(text.encode())
                if held is None:
                    ids.append(one)
                    rows.append({"__part": part, "__edge": 1, "__text": text.encode(), "fingerprint": own})
                else:
                    ids.append(held[0])
                    rows.append({"__part": part, "__edge": 0} | compared(held[1], held[2], text, own))
                held = one, text, own, part
            if rows:
                yield filled(ids, rows)
        if held:
            yield filled([held[0]], [{"__part": held[3], "__edge": 2, "__text": held[1].encode(), "fingerprint": held[2]}])

    def filled(ids: list[pa.Array], rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["__id", *arrow.names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"__part": 0, "__edge": 0} | compared(decoded(text), own.as_py(), decoded(following), other.as_py())
                for text, own, following, other in zip(*batch.columns[1:])
            ]
            if rows:
                yield filled([batch.column(0)], rows)

    keyed = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    order = [F.col("__id").desc_nulls_last(), F.col("__hash")]
    dealt = keyed.withColumn("__hash", F.xxhash64("__text")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = saved(dealt.select("__id", F.spark_partition_id().alias("__part"), "__text").mapInArrow(run, schema))
    # Two rows per range: a bounded number, of which the window sees the numbers alone.
    edges = found.where("__edge > 0")
    ring = Window.orderBy("__part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = edges.where("__edge = 1").select(
        F.col("__part").alias("__own"), F.coalesce(F.lead("__part").over(ring), F.first("__part").over(whole)).alias("__part"))
    start = edges.where("__edge = 1").select("__part", F.col("__text").alias("__following"), F.col("fingerprint").alias("__other"))
    last = edges.where("__edge = 2").select("__id", F.col("__part").alias("__own"), "__text", "fingerprint")
    joined = last.join(after, "__own").join(start, "__part").select("__id", "__text", "fingerprint", "__following", "__other")
    answers = found.where("__edge = 0").unionByName(joined.mapInArrow(meet, schema))
    return answers.select(F.col("__id").alias("doc_id"), *[f.name for f in fields[4:]])


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_likeness(table(spark, sf_dir, "documents"))
