import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmatch.operators import knn
from shelfmatch.plans.retrieval import evaluate_retrieval


@pytest.fixture(scope="module")
def fixture(spark):
    """A third of the references are copies of one vector, and one item owns half of them."""
    rng = np.random.default_rng(7)
    refs = rng.normal(size=(240, 8)).astype(np.float32)
    refs[::3] = refs[0]
    items = ["hot" if i % 2 else f"item{i % 11}" for i in range(240)]
    queries = rng.normal(size=(30, 8)).astype(np.float32)
    models = ["a" if i % 5 else "b" for i in range(240)]
    r = spark.createDataFrame(
        [(f"u{i:03d}", i, items[i], f"s-{items[i]}", models[i], refs[i].tolist()) for i in range(240)],
        "image_uri string, id long, item_id string, slug string, model_name string, embedding array<float>")
    q = spark.createDataFrame(
        [(i, "a" if i % 3 else "b", queries[i].tolist(), items[i]) for i in range(30)],
        "query_id long, model_name string, embedding array<float>, expected string")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    dist = np.round(1 - unit(queries) @ unit(refs).T, 12)
    pairs = {
        i: sorted((dist[i, j], f"u{j:03d}", items[j], j) for j in range(240) if models[j] == ("a" if i % 3 else "b"))
        for i in range(30)
    }
    return q, r, pairs


@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 1000])
def test_knn_join_is_exact(fixture, block_bytes):
    q, r, pairs = fixture
    got = knn.knn_join(q, r, 7, block_bytes=block_bytes).collect()
    assert len(got) == 30 * 7
    for row in got:
        assert pairs[row["query_id"]][row["rank"] - 1][1] == row["image_uri"]


@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 1000])
def test_items_are_distinct_and_exhaustive(fixture, block_bytes):
    q, r, pairs = fixture
    by_item = knn.knn_items(q, r, 4, block_bytes=block_bytes).collect()
    by_row = knn.knn_distinct_items(q, r, 4, block_bytes=block_bytes).collect()
    for found, key in ((by_item, lambda b: (b[0], b[2])), (by_row, lambda b: (b[0], b[3]))):
        assert len(found) == 30 * 4
        for row in found:
            best = {}
            for d, uri, item, j in pairs[row["query_id"]]:
                best.setdefault(item, (d, uri, item, j))
            ranked = sorted(best.values(), key=key)
            assert ranked[row["rank"] - 1][1] == row["image_uri"]


@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 1000])
def test_gallery_rank(fixture, block_bytes):
    q, r, pairs = fixture
    asked = q.withColumn("expected", F.concat(F.lit("u"), F.lpad(F.col("query_id"), 3, "0")))
    ranks, missing = knn.gallery_rank(asked, r, item="image_uri", block_bytes=block_bytes)
    got = {x["query_id"]: x["rank"] for x in ranks.collect()}
    lost = {x["query_id"] for x in missing.collect()}
    for i in range(30):
        names = [p[1] for p in pairs[i]]
        if f"u{i:03d}" in names:
            assert got[i] == names.index(f"u{i:03d}") + 1
        else:
            assert i in lost


def test_zero_vectors_and_empty_index(spark, fixture):
    q, r, _ = fixture
    assert knn.knn_join(q, r.limit(0), 3).count() == 0
    zero = q.withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    assert knn.knn_join(zero, r, 3).count() == 0
    status = knn.no_match_status(q, knn.knn_join(q, r.where("model_name = 'a'"), 1)).collect()
    assert {s["status"] for s in status if s["query_id"] % 3 == 0} == {"no_results"}


def test_evaluation_report(fixture):
    q, r, _ = fixture
    bad = q.withColumn("expected", F.when(F.col("query_id") < 5, "unknown").otherwise(F.col("expected")))
    report = evaluate_retrieval(bad, r, 2)
    row = report["report"].first()
    assert (row["status"], row["queries_total"], row["queries_with_errors"]) == ("partial", 30, report["errors"].count())
    assert report["misses"].count() == row["queries_processed"] - row["correct_queries"]
    none = evaluate_retrieval(bad.where("query_id < 5"), r, 2)
    assert none["report"].first()["status"] == "failed"
    assert all(x["recall"] is None for x in none["recall"].collect())


def test_odd_vectors_meet_nothing_and_hide_nothing(spark):
    nan, inf = float("nan"), float("inf")
    refs = [("A", "a0", [nan, 1.0]), ("A", "a1", [1.0, 0.0]), ("B", "b0", [0.0, 1.0]), ("C", "c0", [1.0, 0.0, 0.0]), ("D", "d0", [inf, 0.0]), ("E", "e0", None), ("F", "f0", [None, 1.0])]
    refs = spark.createDataFrame([(i, "m", u, v) for i, u, v in refs], "item_id string, model_name string, image_uri string, embedding array<double>")
    asked = spark.createDataFrame([(1, "m", [1.0, 0.1]), (2, "m", [nan, 1.0]), (3, "m", [1.0, 0.0, 0.1]), (4, "m", None)], "query_id int, model_name string, embedding array<double>")
    rows = lambda df, c: sorted((r["query_id"], r["rank"], r[c]) for r in df.collect())
    assert rows(knn.knn_items(asked, refs, 5), "item_id") == [(1, 1, "A"), (1, 2, "B"), (3, 1, "C")]
    assert rows(knn.knn_join(asked, refs, 2), "image_uri") == [(1, 1, "a1"), (1, 2, "b0"), (3, 1, "c0")]


def test_tiles_that_cannot_win_are_not_multiplied():
    """Clustered vectors: few cells are multiplied, and the best are those of the whole product."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(30, 16))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    right = unit(centres[draw.integers(0, 30, 3000)] + 0.1 * draw.normal(size=(3000, 16)))
    left = unit(centres[draw.integers(0, 30, 200)] + 0.1 * draw.normal(size=(200, 16)))
    right[5:9] = right[4]
    whole = np.round(1.0 - left @ right.T, knn.TIE_DIGITS)
    dist, multiplied = knn._distances(left, right, 5, knn._tiles(right, 5), None)
    assert multiplied < 0.5 * whole.size
    tie = np.arange(3000)
    assert all((a == b).all() for a, b in zip(knn._smallest(dist, tie, 5), knn._smallest(whole, tie, 5)))
    codes = np.sort(draw.integers(0, 400, 3000))
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    dist, _ = knn._distances(left, right, 5, knn._tiles(right, 5), starts)
    best, want = (np.minimum.reduceat(d, starts, axis=1) for d in (dist, whole))
    picked, wanted = (knn._smallest_of_groups(d, b, starts, tie, 5) for d, b in ((dist, best), (whole, want)))
    assert all((a == b).all() for a, b in zip(picked, wanted))


def test_no_tile_is_left_out_of_vectors_without_clusters():
    draw = np.random.default_rng(8)
    right, left = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (draw.normal(size=(800, 64)), draw.normal(size=(90, 64))))
    dist, _ = knn._distances(left, right, 3, knn._tiles(right, 3), None)
    whole = np.round(1.0 - left @ right.T, knn.TIE_DIGITS)
    assert all((a == b).all() for a, b in zip(knn._smallest(dist, np.arange(800), 3), knn._smallest(whole, np.arange(800), 3)))


def test_a_cell_finds_the_best_without_a_matrix_of_distances(monkeypatch):
    """Unclustered vectors, copies and near ties: the cell agrees with the whole product, which it does not form."""
    rng = np.random.default_rng(3)
    right = rng.normal(size=(1200, 24)).astype(np.float32)
    right[500:600] = right[:100]
    right[600:700] = right[:100] * np.float32(1 + 2e-7)
    left = np.concatenate([rng.normal(size=(100, 24)), right[:30] + 1e-7]).astype(np.float32)
    a, b = (x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True) for x in (left, right))
    whole = np.round(1.0 - a @ b.T, knn.TIE_DIGITS)
    formed = []
    monkeypatch.setattr(knn, "_distances", lambda left, right, *rest, f=knn._distances: formed.append(len(left)) or f(left, right, *rest))
    queries = pd.DataFrame({"query_id": np.arange(130), "__vector": list(left)})
    for groups, k in ((None, 10), (300, 10), (7, 5), (7, 20), (2, 1)):
        refs = pd.DataFrame({"id": np.arange(1200), "__tie": np.arange(1200), "__vector": list(right)})
        refs["g"] = [f"{i % (groups or 1):04}" for i in range(1200)]
        for tie_on_group in (False, True)[: 1 if groups is None else 2]:
            got = knn._cell_function(["query_id"], ["id", "g"], k, groups and "g", tie_on_group)(queries, refs)
            for q in range(0, 130, 3):
                rows = sorted((whole[q, i], i if groups is None or not tie_on_group else refs.g[i], i) for i in range(1200))
                seen, want = set(), []
                for d, _, i in sorted(rows, key=lambda r: (r[0], r[2])):
                    if groups is None or refs.g[i] not in seen:
                        seen.add(refs.g[i])
                        want.append((round(d, 11), refs.g[i] if tie_on_group else "", i))
                mine = got[got.query_id == q]
                assert list(mine.id) == [i for _, _, i in sorted(want)[:k]]
    assert max(formed) <= 64
