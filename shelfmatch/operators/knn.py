"""Exact nearest-neighbour joins.

Pairs are never emitted. References and queries are cut into blocks of bounded bytes by a hash of
their unique keys; each (reference block, query block) cell is one matrix product that keeps only
its best ``k`` rows or items per query. The best of all blocks is the best overall, so a second,
small top-k over the block winners is exact. Nothing is broadcast, and no block grows with a hot
item, model or group of copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.skew import first_per_key, top_per_key

# Distances closer than this are one distance, so that ties do not depend on summation order.
TIE_DIGITS = 12
BLOCK_BYTES = 64 * 1024 * 1024
CELL_MULTIPLIES = 4e9
CELL_WINNERS = 4_000_000


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _smallest(values: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest values per row, ties by ``tie``."""
    if values.shape[1] > k:
        limit = np.partition(values, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(values <= limit)
    else:
        rows, cols = np.nonzero(~np.isnan(values))
    order = np.lexsort((tie[cols], values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _tiles(right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pivots among the references, the pivot of each reference, and the widest angle around each.

    None where tiles of a few times ``k`` references would be too few to leave any out.
    """
    count = min(int(len(right) ** 0.5), len(right) // (4 * k))
    if count < 4:
        return None
    pivots = right[np.linspace(0, len(right) - 1, count).astype(int)]
    angles = np.arccos(np.clip(right @ pivots.T, -1, 1))
    home = angles.argmin(axis=1)
    radius = np.zeros(count)
    np.maximum.at(radius, home, angles[np.arange(len(right)), home])
    return pivots, home, radius


def _distances(left: np.ndarray, right: np.ndarray, k: int, tiles, starts: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Cosine distances that can be among a query's ``k`` best, infinity for others; how many were multiplied.

    Angles between unit vectors obey the triangle inequality: no reference of a tile is nearer to a
    query than their pivot's angle less the tile's radius. After its two nearest tiles a query knows
    ``k`` distances (of groups, where ``starts`` cuts references into groups); tiles that cannot beat the
    k-th of them are left out, so the result is exact.
    """
    if tiles is None:
        return np.round(1.0 - left @ right.T, TIE_DIGITS), len(left) * len(right)
    pivots, home, radius = tiles
    members = [np.flatnonzero(home == t) for t in range(len(pivots))]
    dist, multiplied = np.full((len(left), len(right)), np.inf), 0
    angle = np.arccos(np.clip(left @ pivots.T, -1, 1))
    near = np.argsort(angle, axis=1, kind="stable")[:, :2]
    least = 1.0 - np.cos(np.maximum(angle - radius - 1e-6, 0.0))
    todo = np.zeros(angle.shape, bool)
    todo[np.arange(len(left))[:, None], near] = True
    for again in (False, True):
        if again:
            best = dist if starts is None else np.minimum.reduceat(dist, starts, axis=1)
            bound = np.partition(best, k - 1, axis=1)[:, k - 1] if best.shape[1] >= k else np.full(len(left), np.inf)
            todo = ~todo & (least <= bound[:, None] + 1e-9)
        for tile in np.flatnonzero(todo.any(axis=0)):
            rows, cols = np.flatnonzero(todo[:, tile]), members[tile]
            dist[np.ix_(rows, cols)] = np.round(1.0 - left[rows] @ right[cols].T, TIE_DIGITS)
            multiplied += len(rows) * len(cols)
    return dist, multiplied


def _first_in_groups(dist: np.ndarray, best: np.ndarray, starts: np.ndarray, rows: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """Column of the first of each group's smallest distances, for the chosen rows and groups."""
    sizes = np.diff(np.r_[starts, dist.shape[1]])
    at = np.where(dist == np.repeat(best, sizes, axis=1), np.arange(dist.shape[1]), dist.shape[1])
    return np.minimum.reduceat(at, starts, axis=1)[rows, segs]


def _candidates(near: np.ndarray, k: int, starts: np.ndarray | None, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every pair that can be among a row's ``k`` best, or the best of one of its ``k`` best groups.

    ``near`` are similarities in single precision, wrong by ``slack`` at most. The k-th best of a row, or of
    its groups, is known up to that, so no pair below it by more than twice ``slack`` can win.
    """
    count = near.shape[1]
    # So many best pairs are of k groups at least.
    pairs = k if starts is None else (k - 1) * int(np.diff(np.r_[starts, count]).max()) + 1
    if starts is None or 16 * pairs <= count:
        wide = max(1, count // max(256, 8 * pairs))
        # The best of so many parts of a row are as many pairs: the last of them is a lower bound.
        parts = near[:, : count // wide * wide].reshape(len(near), wide, -1).max(axis=1)
        bound = np.partition(parts, -pairs, axis=1)[:, -pairs] if parts.shape[1] >= pairs else np.full(len(near), -np.inf)
        return np.divmod(np.flatnonzero(near >= (bound - 2 * slack)[:, None].astype(np.float32)), count)
    best = np.maximum.reduceat(near, starts, axis=1)
    bound = np.partition(best, -k, axis=1)[:, -k] - 2 * slack if len(starts) >= k else np.full(len(near), -np.inf)
    bound = bound.astype(np.float32)
    limit = np.where(best >= bound[:, None], best - np.float32(2 * slack), np.float32(np.inf))
    ends = np.r_[starts[1:], count]
    if len(starts) <= max(256, k):
        found = [np.nonzero(near[:, x:y] >= limit[:, [g]]) for g, (x, y) in enumerate(zip(starts, ends))]
        return np.concatenate([r for r, _ in found]), np.concatenate([c + x for (_, c), x in zip(found, starts)])
    rows, cols = np.divmod(np.flatnonzero(near >= bound[:, None]), count)
    keep = near[rows, cols] >= limit[rows, np.repeat(np.arange(len(starts)), ends - starts)[cols]]
    return rows[keep], cols[keep]


def _best(left, right, tie, k, starts, tie_on_group, slack, few) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the ``k`` best pairs or groups of every row, without a matrix of distances.

    Products in single precision (``few``: both sides) leave some candidates a row, whose distances are
    then exact.
    """
    rows, cols = _candidates(few[0] @ few[1].T, k, starts, slack)
    dist = np.round(1.0 - np.einsum("ij,ij->i", left[rows], right[cols]), TIE_DIGITS)
    last = tie[cols]
    if starts is not None:
        code = np.searchsorted(starts, cols, "right")
        order = np.lexsort((cols, dist, code, rows))
        rows, cols, dist, code = rows[order], cols[order], dist[order], code[order]
        first = np.r_[True, (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])]
        rows, cols, dist, code = rows[first], cols[first], dist[first], code[first]
        last = code if tie_on_group else tie[cols]
    order = np.lexsort((last, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], dist[keep]


def _cell_function(query_cols, ref_cols, k, group, tie_on_group):
    def cell(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or refs.empty:
            return pd.DataFrame(columns=[*query_cols, *ref_cols, "distance"])
        sort = ["__tie"] if group is None else [group, "__tie"]
        refs = refs.sort_values(sort, kind="stable").reset_index(drop=True)
        left, right = _unit_rows(queries["__vector"]), _unit_rows(refs["__vector"])
        few, slack = (left.astype(np.float32), right.astype(np.float32)), (right.shape[1] + 4) * 2.0**-23
        tie = refs["__tie"].rank(method="dense").to_numpy()
        starts = None
        if group is not None:
            codes = pd.factorize(refs[group])[0]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        step = max(1, 2_000_000 // len(refs))
        tiles = _tiles(right, k) if len(left) > 2 * len(right) ** 0.5 else None
        if tiles is not None:
            # Tiles pay where they leave out most products, as a few queries show.
            probe = left[np.linspace(0, len(left) - 1, min(len(left), 64)).astype(int)]
            _, multiplied = _distances(probe, right, k, tiles, starts)
            tiles = tiles if multiplied < 0.1 * len(probe) * len(right) else None
        picked_q, picked_r, picked_d = [], [], []
        for begin in range(0, len(left), step):
            part = left[begin : begin + step]
            if tiles is None:
                rows, cols, found = _best(part, right, tie, k, starts, tie_on_group, slack, (few[0][begin : begin + step], few[1]))
            else:
                dist, _ = _distances(part, right, k, tiles, starts)
                if group is None:
                    rows, cols = _smallest(dist, tie, k)
                else:
                    best = np.minimum.reduceat(dist, starts, axis=1)
                    if tie_on_group:
                        rows, segs = _smallest(best, np.arange(len(starts)), k)
                        cols = _first_in_groups(dist, best, starts, rows, segs)
                    else:
                        rows, cols = _smallest_of_groups(dist, best, starts, tie, k)
                found = dist[rows, cols]
            picked_q.append(rows + begin)
            picked_r.append(cols)
            picked_d.append(found)
        q = queries.iloc[np.concatenate(picked_q)][query_cols].reset_index(drop=True)
        r = refs.iloc[np.concatenate(picked_r)][ref_cols].reset_index(drop=True)
        out = pd.concat([q, r], axis=1)
        out["distance"] = np.concatenate(picked_d)
        return out

    return cell


def _smallest_of_groups(dist, best, starts, tie, k):
    """As ``_smallest`` over groups, where equal groups are ordered by their winning row."""
    if best.shape[1] > k:
        limit = np.partition(best, k - 1, axis=1)[:, k - 1 : k]
        rows, segs = np.nonzero(best <= limit)
    else:
        rows, segs = np.nonzero(~np.isnan(best))
    cols = _first_in_groups(dist, best, starts, rows, segs)
    order = np.lexsort((tie[cols], dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep]


def _blocks(queries: DataFrame, refs: DataFrame, vector: str, block_bytes: int, k: int = 1) -> tuple[int, int]:
    """Number of query and reference blocks, from two row counts and one vector's width.

    Cells have bounded bytes, work and, where ``k`` is all there are, rows to return. Of the ways to cut
    so many, the one that copies fewest rows has blocks in the ratio of the two row counts.
    """
    n_q, n_r = queries.count(), refs.count()
    widest = refs.select(F.size(vector).alias("n")).where("n > 0").first()
    dim = widest["n"] if widest else 1
    cells = max(1, -(-n_q * n_r * dim // int(CELL_MULTIPLIES)), -(-n_q * min(k, n_r) // CELL_WINNERS))
    r_blocks = max(1, -(-n_r * dim * 8 // block_bytes), min(cells, round((cells * n_r / max(n_q, 1)) ** 0.5)))
    return max(1, -(-n_q * dim * 8 // block_bytes), -(-cells // r_blocks)), r_blocks


def _usable(vector: str) -> Column:
    """A vector without a direction, or with a missing or infinite component, is at no distance from anything."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(
    queries: DataFrame, refs: DataFrame, k: int, *, tie: str, group: str | None, tie_on_group: bool,
    vector: str, model: str, query_id: str, block_bytes: int,
) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    ref_cols = [c for c in refs.columns if c not in (vector, model)]
    usable = _usable(vector)
    q = queries.where(usable).select(query_id, model, F.col(vector).cast("array<float>").alias("__vector"))
    r = refs.where(usable).select(
        *ref_cols, model, F.col(tie).alias("__tie"), F.col(vector).cast("array<float>").alias("__vector")
    )
    q_blocks, r_blocks = _blocks(queries, refs, vector, block_bytes, k)
    cell = [model, "__width", "__rb", "__qb"]
    q = q.withColumn("__qb", F.pmod(F.xxhash64(query_id), F.lit(q_blocks))).withColumn(
        "__rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))
    )
    r = r.withColumn("__rb", F.pmod(F.xxhash64(tie), F.lit(r_blocks))).withColumn(
        "__qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    # Vectors of different width never meet.
    q = q.withColumn("__rb", F.col("__rb").cast("long")).withColumn("__width", F.size("__vector"))
    r = r.withColumn("__qb", F.col("__qb").cast("long")).withColumn("__width", F.size("__vector"))
    schema = T.StructType([
        queries.schema[query_id], *[refs.schema[c] for c in ref_cols],
        T.StructField("distance", T.DoubleType()),
    ])
    winners = q.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInPandas(
        _cell_function([query_id], ref_cols, k, group, tie_on_group), schema
    )
    if group is not None and r_blocks > 1:
        winners = first_per_key(winners, [query_id, group], [F.col("distance"), F.col(tie)])
    last = group if tie_on_group else tie
    return top_per_key(winners, [query_id], [F.col("distance"), F.col(last)], k)


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "query_id", tie: str = "image_uri",
    vector: str = "embedding", model: str = "model_name", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest same-model references of every query, with ``rank`` and ``distance``."""
    return _search(
        queries, refs, k, tie=tie, group=None, tie_on_group=False, vector=vector, model=model,
        query_id=query_id, block_bytes=block_bytes,
    )


def knn_items(
    queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "query_id", item: str = "item_id",
    tie: str = "image_uri", vector: str = "embedding", model: str = "model_name",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest items, each by its closest reference; equal items in item order."""
    return _search(
        queries, refs, k, tie=tie, group=item, tie_on_group=True, vector=vector, model=model,
        query_id=query_id, block_bytes=block_bytes,
    )


def knn_distinct_items(
    queries: DataFrame, passages: DataFrame, k: int, *, query_id: str = "query_id", slug: str = "slug",
    tie: str = "id", vector: str = "embedding", model: str = "model_name", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest distinct slugs, each by its closest row; equal slugs in row-id order.

    Rows without a slug or of another width than the query never match.
    """
    named = passages.where(F.col(slug).isNotNull() & (F.col(slug) != ""))
    return _search(
        queries, named, k, tie=tie, group=slug, tie_on_group=False, vector=vector, model=model,
        query_id=query_id, block_bytes=block_bytes,
    )


def gallery_rank(
    queries: DataFrame, gallery: DataFrame, *, query_id: str = "query_id", expected: str = "expected",
    item: str = "item_id", vector: str = "embedding", model: str = "model_name", block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Rank of the expected item in a gallery of one vector per item, and queries it does not hold.

    A rank is one more than the number of items before it, so each cell returns one count per query
    and counts are added up: nothing is sorted and no pair leaves its cell. Equal distances are in
    item order.
    """
    queries, gallery = queries.where(_usable(vector)), gallery.where(_usable(vector))
    known = gallery.select(F.col(item).alias(expected), model, F.col(vector).cast("array<float>").alias("__target"))
    q = queries.select(query_id, model, expected, F.col(vector).cast("array<float>").alias("__vector"))
    alike = F.size("__target") == F.size("__vector")
    missing = q.join(known, [expected, model], "left").where(~F.coalesce(alike, F.lit(False))).select(query_id, expected)
    q = q.join(known, [expected, model]).where(alike).withColumn("__width", F.size("__vector"))
    r = gallery.select(item, model, F.col(vector).cast("array<float>").alias("__vector")).withColumn("__width", F.size("__vector"))
    q_blocks, r_blocks = _blocks(queries, gallery, vector, block_bytes)
    cell = [model, "__width", "__rb", "__qb"]
    q = q.withColumn("__qb", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)))
    q = q.withColumn("__rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    r = r.withColumn("__rb", F.pmod(F.xxhash64(item), F.lit(r_blocks)))
    r = r.withColumn("__qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def count(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or refs.empty:
            return pd.DataFrame(columns=[query_id, expected, "before"])
        left, right, target = (_unit_rows(c) for c in (queries["__vector"], refs["__vector"], queries["__target"]))
        wanted = np.round(1.0 - np.einsum("ij,ij->i", left, target), TIE_DIGITS)
        ids, names = refs[item].to_numpy(), queries[expected].to_numpy()
        step, before = max(1, 8_000_000 // len(refs)), []
        for begin in range(0, len(left), step):
            dist = np.round(1.0 - left[begin : begin + step] @ right.T, TIE_DIGITS)
            limit, name = wanted[begin : begin + step, None], names[begin : begin + step, None]
            earlier = (dist < limit) | ((dist == limit) & (ids[None, :] < name))
            before.append((earlier & (ids[None, :] != name)).sum(axis=1))
        out = queries[[query_id, expected]].copy()
        out["before"] = np.concatenate(before)
        return out

    schema = T.StructType([queries.schema[query_id], queries.schema[expected], T.StructField("before", T.LongType())])
    counts = q.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInPandas(count, schema)
    return counts.groupBy(query_id, expected).agg((F.sum("before") + 1).alias("rank")), missing


def same_width(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return df.where(F.size(vector) == dim)


def pooled(chunks: DataFrame, key: str = "id", weight: str = "weight", vector: str = "embedding") -> DataFrame:
    """Weighted sum of chunk vectors per key, made a unit vector again."""
    from shelfmatch.functions.vectors import l2_normalize

    parts = chunks.select(key, weight, F.posexplode(vector).alias("pos", "x"))
    sums = parts.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double") * F.col(weight)).alias("x"))
    # One vector per key is as wide as the model, so this list is bounded by its dimension.
    vectors = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return vectors.select(key, l2_normalize(F.transform("v", lambda e: e["x"])).alias("embedding"))


def no_match_status(queries: DataFrame, ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query: ok, or no_results when nothing of its model is indexed."""
    hit = ranked.select(query_id).distinct().withColumn("__hit", F.lit(True))
    status: Column = F.when(F.col("__hit"), "ok").otherwise("no_results")
    return queries.select(query_id).join(hit, query_id, "left").select(query_id, status.alias("status"))
