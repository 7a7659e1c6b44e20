"""Language-model scores by stupid backoff over n-gram count tables (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import table, text_or_empty, words

BACKOFF = 0.4


class _Hashes(dict):
    """64-bit hashes of words; a bounded number are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and that of its last."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + word
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _exploded(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All word positions of the texts: text number, place in it, and the hashes of the n-grams that
    end there, per n (those with too few words before them are never read)."""
    parts = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    of = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [np.concatenate([np.fromiter(map(_HASHES.__getitem__, p), np.uint64, len(p)) for p in parts] or [np.zeros(0, np.uint64)])]
    for _ in range(1, order):
        grams.append(np.concatenate([grams[0][:1], _joined(grams[-1][:-1], grams[0][1:])]))
    return of, place, grams


def _planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, high ones together: mostly zeros, which the shuffle's compression removes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets in sorted hashes; a bucket is a range of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def _block_counts(docs: pa.Table, order: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(n, bucket, sorted distinct hashes, counts) of a block of documents."""
    _, place, grams = _exploded(docs.column("__text").to_pylist(), order)
    for n, hashes in enumerate(grams):
        keys, counts = np.unique(hashes[place >= n], return_counts=True)
        start = 0
        for bucket, end in enumerate(_slices(keys, buckets)):
            if end > start:
                yield n, bucket, keys[start:end], counts[start:end]
            start = end


def _block_scores(docs: pa.Table, totals: pa.Table, order: int, all_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and score of every document of a block."""
    of, place, grams = _exploded(docs.column("__text").to_pylist(), order)
    size = docs.num_rows
    n_words = np.bincount(of, minlength=size)
    rest = np.maximum(1, all_words - n_words)[of]
    parts: dict[int, dict[int, bytes]] = {}
    # A block without words has no totals, and then an empty table without columns.
    for n, bucket, data in zip(*(totals.column(c).to_pylist() for c in ("n", "bucket", "totals") if totals.num_rows)):
        parts.setdefault(n, {})[bucket] = data
    others = []  # per n and position: how often the n-gram occurs in other documents
    for n, hashes in enumerate(grams):
        found = np.zeros(len(hashes), np.int64)
        at = place >= n
        _, which = np.unique(hashes[at], return_inverse=True)
        if len(which):
            total = np.concatenate([_from_planes(d) for _, d in sorted(parts[n].items())]).astype(np.int64)
            _, own_at, own = np.unique(which * size + of[at], return_inverse=True, return_counts=True)
            found[at] = total[which] - own[own_at]
        others.append(found)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(others[0] > 0, np.log(others[0] / rest), np.log(BACKOFF) - np.log(rest))
        for n in range(1, order):
            context = np.concatenate([others[n - 1][:1], others[n - 1][:-1]])
            longer = np.where(others[n] > 0, np.log(others[n] / context), np.log(BACKOFF) + score)
            score = np.where(place >= n, longer, score)
    return n_words, np.bincount(of, weights=score, minlength=size).astype(np.float64)


def backoff_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
    chars_per_block: int = 4_000_000, grams_per_bucket: int = 3_000_000,
) -> DataFrame:
    """Score every document under the n-gram counts of all other documents.

    Words are what blanks separate. For a word after n - 1 others of the same document, the score is
    the logarithm of count(n-gram) / count(first n - 1 words) if the n-gram occurs in another document,
    else that of 0.4 times the score with one word less; at the end stands count(word) / words, or
    0.4 / words for a word that no other document has. Counts leave the document itself out.

    Documents go to blocks by hash (the only time a text is moved). A block sends its distinct
    n-grams and counts to the count table, which is partitioned by ranges of the n-gram's hash; each
    partition adds them up and sends every block the totals of its n-grams in the order they came. The
    block joins them to its exploded n-grams and sums per document. So an n-gram that fills a third
    of all positions is one entry per block, and no task holds more than a block or a bucket; both
    grow in number with the input, not in size. N-grams are told apart by 64-bit hashes.

    Returns ``doc_id, n_words, score`` (natural logarithm, summed) and ``mean_score`` (per word, null
    without words). Null and blank texts have score 0. Identifiers may be null or repeat: each row is
    a document of its own. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    chars, all_words = rows.agg(
        F.coalesce(F.sum(F.length("__text")), F.lit(0)), F.coalesce(F.sum(F.size(words(F.col("__text")))), F.lit(0))
    ).first()
    blocks, buckets = 1 + chars // chars_per_block, 1 + order * all_words // grams_per_bucket
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(
        "__id", F.col("__text").cast("binary").alias("__text"),
        F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)).alias("__block"),
    ).repartition(max(shuffles, min(blocks, 4 * shuffles)), "__block")

    def count(docs: pa.Table) -> pa.Table:
        block = docs.column("__block")[0].as_py()
        found = [
            (bucket, block, n, _planes(np.diff(keys, prepend=np.uint64(0))), _planes(counts))
            for n, bucket, keys, counts in _block_counts(docs, order, buckets)
        ]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*found) if found else [[]] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["bucket", "__block", "n", "grams", "counts"])

    def add_up(entries: pa.Table) -> pa.Table:
        out = []
        places = entries.column("n").to_numpy()
        for n in np.unique(places):
            part = entries.filter(pa.array(places == n))
            keys = [np.cumsum(_from_planes(d), dtype=np.uint64) for d in part.column("grams").to_pylist()]
            counts = np.concatenate([_from_planes(d) for d in part.column("counts").to_pylist()])
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(which.max() + 1, np.uint64)
            np.add.at(sums, which, counts)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            totals = [_planes(t) for t in np.split(sums[which], ends)]
            out.append(part.drop_columns(["grams", "counts"]).append_column("totals", pa.array(totals, pa.binary())))
        return pa.concat_tables(out)

    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        n_words, scores = _block_scores(docs, totals, order, all_words)
        means = [s / n if n else None for s, n in zip(scores, n_words)]
        return pa.table([docs.column("__id"), pa.array(n_words, pa.int64()), pa.array(scores), pa.array(means, pa.float64())], names=["doc_id", "n_words", "score", "mean_score"])

    entries = dealt.groupBy("__block").applyInArrow(count, "bucket int, __block bigint, n int, grams binary, counts binary")
    totals = entries.groupBy("bucket").applyInArrow(add_up, "bucket int, __block bigint, n int, totals binary")
    schema = T.StructType([
        T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("mean_score", T.DoubleType()),
    ])
    return dealt.groupBy("__block").cogroup(totals.groupBy("__block")).applyInArrow(score, schema)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.withColumns({"score": F.round("score", 6), "mean_score": F.round("mean_score", 9)})


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM p),
n AS (SELECT count(*) AS k FROM p),
u AS (SELECT w, count(*) AS c FROM p GROUP BY w),
du AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY doc_id, w),
t AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
dt AS (SELECT doc_id, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY doc_id, v, w),
s AS (
  SELECT b.doc_id, CASE WHEN b.v IS NOT NULL AND t.c > dt.c THEN ln((t.c - dt.c) / (uv.c - dv.c))
    ELSE CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN u.c > du.c THEN ln((u.c - du.c) / greatest(1, n.k - d.n))
      ELSE ln(0.4) - ln(greatest(1, n.k - d.n)) END END AS x
  FROM b JOIN (SELECT doc_id, len(ws) AS n FROM d) AS d USING (doc_id) CROSS JOIN n JOIN u ON u.w = b.w JOIN du ON du.doc_id = b.doc_id AND du.w = b.w
  LEFT JOIN t ON t.v = b.v AND t.w = b.w LEFT JOIN dt ON dt.doc_id = b.doc_id AND dt.v = b.v AND dt.w = b.w
  LEFT JOIN u AS uv ON uv.w = b.v LEFT JOIN du AS dv ON dv.doc_id = b.doc_id AND dv.w = b.v
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(e.x, 0), 6) AS score, round(e.x / len(d.ws), 9) AS mean_score
FROM d LEFT JOIN (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id) AS e USING (doc_id)
"""
