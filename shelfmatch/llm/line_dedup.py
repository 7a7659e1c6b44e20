"""Line de-duplication by a segment-partition edit join (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import let, saved, table, text_or_empty

BASE = np.uint64(0x5851F42D4C957F2D)
#: Inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Characters of lines that are hashed together, and line identifiers that a task remembers.
CHUNK, REMEMBERED = 1_000_000, 500_000


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``: bit-parallel inside a band.

    Bit d of ``reach[e]`` says that the first i characters of ``a`` become the first i + d - most of
    ``b`` in e edits or fewer. Only 2 * most + 1 diagonals can end in time, so a row is one small number.
    """
    if abs(len(a) - len(b)) > most:
        return False
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    band = (1 << (2 * most + 1)) - 1
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    reach = [((1 << (e + 1)) - 1) << most for e in range(most + 1)]
    for i, c in enumerate(a):
        places = at.get(c, 0)
        equal = (places >> (i - most) if i >= most else places << (most - i)) & band
        row, below = [], 0
        for e in range(most + 1):
            now = reach[e] & equal
            if e:
                now |= reach[e - 1] | reach[e - 1] >> 1 | below << 1
            below = now & band
            row.append(below)
        reach = row
        if not reach[most]:
            return False
    return bool(reach[most] >> (len(b) - len(a) + most) & 1)


def _lines(text: bytes | None, least: int, short: bool = False) -> Iterator[tuple[int, str]]:
    """Places and lines of a text that have ``least`` characters, or with ``short`` are not blank."""
    if text:
        for at, line in enumerate(text.decode("utf-8", "replace").split("\n")):
            if len(line) >= least or short and line.strip():
                yield at, line


def _identify(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(line.encode())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def occurrences(rows: DataFrame, least: int, short: bool = False) -> DataFrame:
    """Every line of ``least`` characters (with ``short``, every shorter one that is not blank too): the row's keys, ``pos`` and a 128-bit identifier."""
    keys = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (i, at, *_identify(line))
                for i, text in enumerate(batch.column(len(keys))) for at, line in _lines(text.as_py(), least, short)
            ]
            of, pos, l1, l2 = ([x[k] for x in found] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]), pa.array(pos, pa.int32()), pa.array(l1, pa.int64()), pa.array(l2, pa.int64())],
                names=[*keys, "pos", "l1", "l2"],
            )

    more = [T.StructField("pos", T.IntegerType()), T.StructField("l1", T.LongType()), T.StructField("l2", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *more]))


class _Chunk:
    """Code points of some lines, with hashes of any substring."""

    def __init__(self, lines: list[str]) -> None:
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.sizes) - self.sizes
        points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = len(points)
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, INVERSE)]))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power)])
        pairs = points * np.uint64(0x9E3779B97F4A7C15) ^ np.roll(points, -1) * np.uint64(0xC2B2AE3D27D4EB4F)
        bits = np.uint64(1) << (pairs * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58))
        bits[self.starts + self.sizes - 1] = 0
        self.signature = np.bitwise_xor.reduceat(bits, self.starts).view(np.int64)

    def key(self, at: np.ndarray, size: np.ndarray, segment: int, length: np.ndarray) -> np.ndarray:
        """Hash of segment number, length of the segmented line, and the substring of ``size`` at ``at``."""
        x = (self.sums[at + size] - self.sums[at]) * self.inverse[at]
        x ^= length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64((segment + 1) * 0xE7037ED1A0B428DB % (1 << 64))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ x >> np.uint64(32)).view(np.int64)


def _index_keys(chunk: _Chunk, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) of the ``most`` + 1 segments."""
    length = chunk.sizes
    for i in range(most + 1):
        first, last = i * length // (most + 1), (i + 1) * length // (most + 1)
        yield np.arange(len(length)), chunk.key(chunk.starts + first, last - first, i, length)


def _probe_keys(chunk: _Chunk, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) of the substrings that may equal a segment of a line as long or up to ``most`` shorter.

    Segment i (from 0) can only be shifted by i edits before it, and by ``most`` - i after it; only
    shifts that both sides allow are looked up.
    """
    for less in range(most + 1):
        length = chunk.sizes - less
        for i in range(most + 1):
            first, last = i * length // (most + 1), (i + 1) * length // (most + 1)
            for shift in range(max(-i, less - (most - i)), min(i, less + (most - i)) + 1):
                at = first + shift
                fits = np.flatnonzero((at >= 0) & (at + last - first <= chunk.sizes))
                yield fits, chunk.key((chunk.starts + at)[fits], (last - first)[fits], i, length[fits])


def segment_keys(rows: DataFrame, least: int, most: int, keys_of: Callable) -> DataFrame:
    """``key, l1, sig`` for every line of ``least`` characters that the task has not met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def out(lines: list[str], names: list[int]) -> pa.RecordBatch:
            chunk, ids = _Chunk(lines), np.array(names, np.int64)
            found = list(keys_of(chunk, most))
            of = np.concatenate([w for w, _ in found])
            columns = [np.concatenate([k for _, k in found]), ids[of], chunk.signature[of]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "l1", "sig"])

        for batch in batches:
            lines, names, chars = [], [], 0
            for text in batch.column(0):
                for _, line in _lines(text.as_py(), least):
                    name = _identify(line)[0]
                    if name in met:
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met.add(name)
                    lines.append(line)
                    names.append(name)
                    chars += len(line)
                    if chars >= CHUNK:
                        yield out(lines, names)
                        lines, names, chars = [], [], 0
            if lines:
                yield out(lines, names)

    found = rows.select(rows.columns[-1]).mapInArrow(run, "key bigint, l1 bigint, sig bigint")
    # One exchange: copies that several tasks sent go where they are joined.
    return found.repartition("key").dropDuplicates(["key", "l1"])


def candidates(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs ``a, b`` (a < b) of line identifiers that share a segment and may be close.

    ``sig`` has the parity of the line's hashed character pairs in 64 classes. One edit changes four
    pairs at most, so lines within ``most`` edits differ in 4 * ``most`` bits or fewer.
    """
    index, probe = (segment_keys(rows, least, most, of) for of in (_index_keys, _probe_keys))
    probe = probe.select("key", F.col("l1").alias("p1"), F.col("sig").alias("psig"))
    alike = F.bit_count(F.col("sig").bitwiseXOR(F.col("psig"))) <= 4 * most
    return (
        index.join(probe, "key").where((F.col("l1") != F.col("p1")) & alike)
        .select(F.least("l1", "p1").alias("a"), F.greatest("l1", "p1").alias("b")).distinct()
    )


def _verified(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (all columns but the two texts) whose texts are within ``most`` edits."""
    kept = [c for c in pairs.columns if c not in ("a_line", "b_line")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist())
            good = pa.array([within(a, b, most) for a, b in texts], pa.bool_())
            yield batch.select(kept).filter(good)

    return pairs.mapInArrow(run, T.StructType([pairs.schema[c] for c in kept]))


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 30, most_edits: int = 2,
    short_repeats: bool = False,
) -> DataFrame:
    """Drop every line that an earlier line of the corpus repeats, exactly or within ``most_edits``.

    Lines are what newlines separate, in the order of identifier (null last, then by the text's
    hash) and place. Lines under ``least_chars`` characters are never dropped, unless ``short_repeats``:
    then exact repeats of those that are not blank are, and ``least_chars`` holds for edits only (two
    edits make other words of a short line; lower ``least_chars`` with ``most_edits`` to compare those too). A line is dropped if an earlier place has the same line, or if a line within ``most_edits`` edits
    of it occurs first at an earlier place. Returns all columns with the text that is left, and
    ``n_lines``, ``n_dropped`` and ``n_links`` (different lines within ``most_edits`` of lines that occur
    first in this document). A document may be left empty; no row is dropped. Null texts stay null
    and have no lines. Rows that repeat identifier and text count as one document and get the same
    answer each. Columns that begin with two underscores or have the added names are replaced.

    Equal lines are combined by a 128-bit identifier before pairs are looked for, so copies are
    never paired. A pair within k edits has one of the k + 1 segments of the shorter line whole, at
    a place at most k away: segments and substrings meet by hash, length and number. Texts are read
    only for pairs whose signatures allow them; they move once, by document, for that and for the answer.
    """
    keys = ["__null", "__id", "__hash"]
    kind = df.schema[id_col].dataType
    keyed = df.withColumns({
        "__null": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0).cast(kind)), "__hash": F.xxhash64(text_col),
    })
    rows = keyed.select(*keys, F.col(text_col).cast("binary").alias("__text"))
    places = saved(occurrences(rows, least_chars, short_repeats))
    first = F.min(F.struct(*keys, "pos")).alias("first")
    lines = saved(places.groupBy("l1", "l2").agg(first))
    pairs = saved(candidates(rows, least_chars, most_edits))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, *keys)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("l1")).distinct()
    asked = lines.join(wanted, "l1").groupBy(*[F.col(f"first.{k}").alias(k) for k in keys]).agg(
        F.collect_list(F.struct("first.pos", "l1", "l2")).alias("__asked")
    )
    sentences = dealt.join(asked, keys).dropDuplicates(keys).select(
        *keys, F.explode(let(F.split(text_or_empty(text_col), "\n"), lambda all_: F.transform(
            "__asked", lambda x: F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"), x["pos"].alias("pos"), F.get(all_, x["pos"]).alias("line"))
        ))).alias("__one")
    ).select(F.struct(*keys, "__one.pos").alias("first"), "__one.l1", "__one.l2", "__one.line")

    def side(name: str) -> DataFrame:
        return sentences.select(F.col("l1").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("l2", "first", "line")])

    links = _verified(pairs.join(side("a"), "a").join(side("b"), "b"), most_edits)
    ends = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("l1"), F.col("a_l2").alias("l2"), (F.col("b_first") < F.col("a_first")).alias("late")),
        F.struct(F.col("b").alias("l1"), F.col("b_l2").alias("l2"), (F.col("a_first") < F.col("b_first")).alias("late")),
    )).alias("e")).select("e.*")
    linked = ends.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("links"), F.bool_or("late").alias("late"))
    known = lines.join(linked, ["l1", "l2"], "left")
    here = F.struct(*keys, "pos") == F.col("first")
    judged = places.join(known, ["l1", "l2"]).select(
        *keys, "pos", (~here | F.coalesce("late", F.lit(False))).alias("drop"),
        F.when(here, F.coalesce("links", F.lit(0))).otherwise(0).alias("links"),
    ).where("drop or links > 0")
    drops = judged.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("drop"), F.col("pos"))).alias("__drop"), F.sum("links").alias("__links")
    )
    found = dealt.join(drops, keys, "left")
    none = F.array().cast("array<int>")
    split = F.split(F.col(text_col), "\n")

    def left(all_: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.coalesce("__drop", none))
        return F.array_join(F.transform(stay, lambda i: all_[i]), "\n")

    text = F.when(F.size(F.coalesce("__drop", none)) == 0, F.col(text_col)).otherwise(let(split, left))
    count = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))
    added = {
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(count).cast("long"),
        "n_dropped": F.size(F.coalesce("__drop", none)).cast("long"), "n_links": F.coalesce("__links", F.lit(0)).cast("long"),
    }
    own = [F.col(c) if c != text_col else text.alias(text_col) for c in df.columns if c not in added]
    return found.select(*own, *[v.alias(k) for k, v in added.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)


#: DuckDB's distance counts bytes: letters of the tables' four languages become one byte each before they are compared.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, doc_id * 10000000 + generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents
),
e AS (
  SELECT line, min(k) AS first, length(line) AS n,
    translate(line, '{LETTERS}', '{"".join(map(chr, [*range(1, 9), *range(14, 27)]))}') AS folded
  FROM l WHERE length(line) >= 30 OR regexp_matches(line, '\S') GROUP BY line
),
p AS (
  SELECT a.line AS early, b.line AS late FROM e a JOIN e b ON a.n BETWEEN b.n - 2 AND b.n + 2
  WHERE a.n >= 30 AND b.n >= 30 AND a.first < b.first AND levenshtein(a.folded, b.folded) <= 2
),
c AS (SELECT line, count(*) AS links FROM (SELECT early AS line FROM p UNION ALL SELECT late FROM p) GROUP BY line),
j AS (
  SELECT l.doc_id, l.k, l.line, e.line IS NOT NULL AND (e.first <> l.k OR l.line IN (SELECT late FROM p)) AS gone,
    CASE WHEN e.first = l.k THEN coalesce(c.links, 0) ELSE 0 END AS links
  FROM l LEFT JOIN e ON e.line = l.line LEFT JOIN c ON c.line = l.line
),
r AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
    count(*) FILTER (gone) AS n_dropped, CAST(sum(links) AS BIGINT) AS n_links
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dropped, 0) AS n_dropped, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN r USING (doc_id)
"""
