"""Near-duplicates by SimHash fingerprints and shared shingles: both find candidates, exact similarity decides."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import saved
from shelfmatch.llm.components import connected
from shelfmatch.llm.simhash import fingerprint, smallest_linked

#: A pair of similarity 0.8 shares a band of five minima with probability 0.33, so one of 24 with 0.99993.
BANDS, ROWS = 24, 5
#: Shingles hashed at once; nodes up to which a band's bucket stays whole; bands that larger ones are split by.
CHUNK, CROWDED, PARTNERS = 4096, 64, 8
#: Least hashes of a text that cells compare; nodes on one side of a cell, about.
KEPT, SIDE = 512, 64
_DRAW = np.random.default_rng(42)
FACTORS = _DRAW.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, a blank one none."""
    parts = (data or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(parts)] if len(parts) < size else map(b" ".join, zip(*(parts[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; two blank texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        mixed = found[at : at + CHUNK, None] * FACTORS + OFFSETS
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed hash per band: its number and ``ROWS`` minima."""
    return [
        xxhash.xxh3_64_intdigest(bytes([i]) + least[i * ROWS : (i + 1) * ROWS].tobytes()) - (1 << 63) for i in range(BANDS)
    ]


def sketch(least: np.ndarray) -> bytes:
    """One byte of each minimum: equal bytes estimate the similarity."""
    return (least >> np.uint64(17)).astype(np.uint8).tobytes()


def fewest_equal(least: float) -> int:
    """Equal bytes below which a pair as alike as ``least`` falls once in 200,000 times."""
    n = BANDS * ROWS
    return int(n * least - 4.5 * (n * least * (1 - least)) ** 0.5)


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The KEPT least of sorted shingle hashes, their upper halves; fewer than KEPT are the whole set."""
    return (found[:KEPT] >> np.uint64(32)).astype(np.uint32)


def alike(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Square of booleans: which of the sets of ``least_hashes`` may be similar to ``least`` or more; the diagonal means nothing.

    Two whole sets are compared exactly, but for two hashes that may agree by chance. Others are
    known up to the smaller of their last hashes; a pair as alike as ``least`` falls below the bound
    once in 200,000 times.
    """
    top = np.iinfo(np.uint32).max
    ends = np.array([s[-1] if len(s) == KEPT else top for s in sets], np.uint32)
    sizes = np.array([np.searchsorted(s, ends, "right") for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), times > 1
    held = np.zeros((len(sets), int(shared.sum())), np.float32)
    here = shared[at]
    held[of[here], (np.cumsum(shared) - 1)[at[here]]] = 1
    both = held @ held.T
    either = sizes + sizes.T - both
    whole = ends == top
    slack = np.where(whole[:, None] & whole, 2, 4.5 * np.sqrt(either * least * (1 - least)))
    return both >= either * least - slack


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """All columns but the last, which is the text; ``node``, a hash of its shingles, ``bands``, ``sketch`` and SimHash ``fp``."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, short, prints = [], [], [], []
            for text in batch.column(len(kept)):
                data = text.as_py()
                one = shingles(data, size)
                least = minima(one)
                nodes.append(xxhash.xxh3_64_intdigest(one.tobytes()) - (1 << 63))
                found.append(bands(least))
                short.append(sketch(least))
                prints.append(fingerprint(data))
            more = [pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*kept, "node", "bands", "sketch", "fp"])

    more = T.StructType.fromDDL("node bigint, bands array<bigint>, sketch binary, fp bigint")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *more]))


def _promising(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Distinct pairs whose sketches do not rule out a similarity of ``least``; no text moves."""
    wanted = fewest_equal(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in batch.columns[2:])
            near = pa.array((x == y).sum(axis=1) >= wanted)
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in batch.columns[:2]], names=["a", "b"])

    short = nodes.select("node", "sketch")
    one = pairs.distinct().join(short.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = one.join(short.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows ``k, node, root`` of buckets with several roots dealt to cells ``k, i, j`` of bounded size.

    Nodes outside a bucket's commonest root are split into parts of about SIDE, and so are those
    inside it. Parts outside meet each other and all parts inside; parts inside do not meet.
    ``side`` is the number of a row's part; a cell has the rows of parts i and j.
    """
    sizes = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("k").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"))
    inside = F.col("most.n")
    mixed = mixed.where("roots > 1").select(
        "k", F.col("most.root").alias("most"), F.ceil((F.col("n") - inside) / SIDE).alias("outer"), F.ceil(inside / SIDE).alias("inner"))
    outside = F.col("root") != F.col("most")
    part = F.pmod(F.xxhash64("node"), F.when(outside, F.col("outer")).otherwise(F.col("inner")))
    rows = placed.join(mixed, "k").withColumn("out", outside).withColumn("side", F.when(outside, part).otherwise(F.col("outer") + part))
    side, zero = F.col("side"), F.lit(0).cast("long")
    with_outer = F.transform(F.sequence(zero, F.col("outer") - 1), lambda x: F.struct(
        F.least(x, side).alias("i"), F.greatest(x, side).alias("j")))
    with_inner = F.transform(F.sequence(F.col("outer"), F.col("outer") + F.col("inner") - 1), lambda x: F.struct(side.alias("i"), x.alias("j")))
    cells = F.when(F.col("out"), F.concat(with_outer, with_inner)).otherwise(with_outer)
    return rows.select("k", "node", "root", "side", F.explode(cells).alias("cell")).select("k", "cell.*", "side", "node", "root")


def _met_in_cells(placed: DataFrame, known: DataFrame, size: int, least: float) -> DataFrame:
    """Distinct pairs ``a, b`` of one bucket (``placed``: ``k, node, root``) and of different roots that may be close.

    Every such pair meets in one cell, and only those that their hashes do not rule out become rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [least_hashes(shingles(t.as_py(), size)).tobytes() for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(few, pa.binary())], names=["node", "few"])

    def met(cell: list[pa.RecordBatch], i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(cell)
        node, root, side = (rows.column(c).to_numpy() for c in ("node", "root", "side"))
        near = root[:, None] != root
        if i != j:
            near &= side[:, None] != side
        if near.any():
            near &= alike([np.frombuffer(x, np.uint32) for x in rows.column("few").to_pylist()], least)
        x, y = np.nonzero(np.triu(near))
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, last, found = [], None, []

        def told() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[at] for f in found)]) for at in (0, 1))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("k", "i", "j")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                key = tuple(keys[start].tolist())
                if cell and key != last:
                    found.append(met(cell, *last[1:]))
                    cell = []
                last = key
                cell.append(batch.slice(start, end - start))
            yield told()
        if cell:
            found.append(met(cell, *last[1:]))
            yield told()

    dealt = saved(_dealt(placed))
    few = known.join(dealt.select("node").distinct(), "node").select("node", "__text").mapInArrow(hashed, "node bigint, few binary")
    cells = dealt.join(few, "node").select("k", "i", "j", "side", "node", "root", "few")
    return cells.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def _checked(pairs: DataFrame, known: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs ``a, b`` of nodes with ``good``: whether their shingles are at least ``least`` similar.

    ``known`` has the text of every node. Texts of the second come first, since many pairs may share
    the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a"), batch.column("__x"), batch.column("__y")):
                if a != last:
                    last, one = a, shingles(x.as_py(), size)
                good.append(similarity(one, shingles(y.as_py(), size)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    second = pairs.join(known.select(F.col("node").alias("b"), F.col("__text").alias("__y")), "b")
    both = second.join(known.select(F.col("node").alias("a"), F.col("__text").alias("__x")), "a")
    return both.select("a", "b", "__x", "__y").mapInArrow(run, "a bigint, b bigint, good boolean")


def buckets(nodes: DataFrame) -> DataFrame:
    """``k, node``: nodes that share a key ``k`` may be close, and every key here has two nodes at least.

    A key is a band. A band that more than CROWDED nodes share gives way to its combinations with the
    next PARTNERS bands, which only closer nodes share. Two nodes that share three bands nearly always
    share such a pair, and a pair of similarity 0.8 shares eight of 24 on average.
    """
    keyed = nodes.select("node", F.posexplode("bands").alias("i", "k"), "bands")
    sizes = nodes.select(F.explode("bands").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(keyed.join(sizes, "k"))
    after = F.array(*[F.get("bands", F.pmod(F.col("i") + d, F.lit(BANDS))) for d in range(1, PARTNERS + 1)])
    split = shared.where(F.col("n") > CROWDED).select("node", "k", F.explode(after).alias("next")).select(F.xxhash64("k", "next").alias("k"), "node")
    many = split.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return shared.where(F.col("n") <= CROWDED).select("k", "node").union(split.join(many, "k"))


def print_buckets(nodes: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """``k, node``: nodes whose SimHash fingerprints are linked, one key per component of fingerprints.

    The links are those of ``simhash``: pigeonhole blocks find all fingerprints within ``distance`` bits.
    Nodes of one fingerprint are linked as well.
    """
    prints = nodes.select("node", F.explode("prints").alias("__fp"))
    linked = smallest_linked(prints, F.col("__fp"), distance, blocks)
    keyed = saved(prints.join(linked, "__fp").select(F.xxhash64(F.lit("print"), "__component").alias("k"), "node").distinct())
    many = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return keyed.join(many, "k")


def close_links(nodes: DataFrame, texts: DataFrame, keys: list[str], size: int, least: float) -> DataFrame:
    """Verified links ``a, b`` that connect all nodes which share a bucket and are close.

    Buckets are those of linked SimHash fingerprints (``print_buckets``) and of min-hash bands
    (``buckets``). First every node meets one leader, the smallest node of a bucket, that of most of its
    buckets: one pair a node connects groups of copies. Then nodes that are still apart from a leader of
    theirs meet it. Last, in each bucket that still has nodes of several components, every node outside its largest
    component meets all nodes of other components, in cells of bounded size that compare hashes and
    return the pairs that may be close. So no two close nodes of a bucket are left in different
    components. The plan is the same for any data: three passes of candidates, hashes and whole texts.
    """
    members = saved(print_buckets(nodes).union(buckets(nodes)))
    wanted = members.select("node").distinct()
    asked = nodes.join(wanted, "node").select("node", "first.*")
    known = saved(texts.join(asked, keys).dropDuplicates(["node"]).select("node", "__text"))

    def verified(pairs: DataFrame) -> DataFrame:
        return saved(_checked(saved(_promising(pairs, nodes, least)), known, size, least))

    leads = members.groupBy("k").agg(F.min("node").alias("a"))
    led = saved(members.join(leads, "k").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    best = led.groupBy("b").agg(F.max_by("a", F.struct("n", F.bitwise_not("a"))).alias("a")).select("a", "b")
    done = verified(best)

    roots = connected(done.where("good").select("a", "b"))
    of = roots.select(F.col("node").alias("b"), F.col("root").alias("of_b"))
    apart = led.join(roots, led["a"] == roots["node"], "left").join(of, "b", "left").where(
        F.coalesce("root", "a") != F.coalesce("of_b", "b")).select("a", "b")
    done = done.union(verified(apart.join(done.select("a", "b"), ["a", "b"], "left_anti")))

    roots = connected(done.where("good").select("a", "b"))
    placed = saved(members.join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")))
    pairs = saved(_met_in_cells(placed, known, size, least).join(done.select("a", "b"), ["a", "b"], "left_anti"))
    done = done.union(saved(_checked(pairs, known, size, least)))
    return saved(done.where("good").select("a", "b"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each group of near-duplicates.

    Rows are linked if the sets of their runs of ``size`` words (ASCII case ignored) have a Jaccard
    similarity of ``least`` or more, and groups follow links. Candidates have linked SimHash
    fingerprints (``print_buckets``) or share a bucket of min-hash bands (``buckets``), which finds copies
    that differ in more bits: a pair of similarity 0.8 has one in all but one of 15,000 cases, or of 100
    where every band of it is crowded; a link is always verified on whole texts.
    The smallest identifier stays; null identifiers come last and are told apart by their text. Of
    rows that repeat identifier and text, one stays. Null and blank texts are alike.
    """
    keys = ["__null", "__id", "__hash"]
    kind = df.schema[id_col].dataType
    keyed = df.withColumns({
        "__null": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0).cast(kind)), "__hash": F.xxhash64(text_col),
    })
    texts = keyed.select(*keys, F.col(text_col).cast("binary").alias("__text"))
    first = F.struct(*keys)
    # Copies are combined before any bucket is formed.
    nodes = saved(_sketches(texts, size).groupBy("node").agg(
        F.min(first).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"),
        F.collect_set("fp").alias("prints")))
    roots = connected(close_links(nodes, texts, keys, size, least))
    linked = nodes.select("node", "first").join(roots, "node")
    best = linked.groupBy("root").agg(F.min("first").alias("first"))
    alone = nodes.join(roots, "node", "left_anti").select("first")
    stay = alone.union(best.select("first")).select("first.*")
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*df.columns)
