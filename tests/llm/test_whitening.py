"""Whitening against plain sums and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from shelfmatch.llm import whitening
from shelfmatch.llm.whitening import components, cross_products, op12_whitening, packed, scatter, whitened

SCHEMA = "vec_id bigint, embedding array<double>, label int, __v string, deviation string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("rows, top", [(1, 5), (63, 100), (64, 1), (65, 130), (400, 1 << 33)])
def test_counted_bits_give_exact_products(rows, top):
    draw = np.random.default_rng(rows)
    values = draw.integers(0, top, (rows, 7))
    values[:, 3] = 0
    words, dims, bits = packed(values)
    assert words.shape == (len(dims), -(-rows // 64)) and 3 not in dims
    big = values.astype(object)
    assert (cross_products(values).astype(object) == np.triu(big.T @ big)).all()


def test_shifts_are_put_back(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 50)
    values = np.random.default_rng(2).integers(-(1 << 37), 1 << 37, (333, 5))
    n, sums, products = scatter(values)
    big = values.astype(object)
    assert n == 333 and (sums == big.sum(axis=0)).all()
    assert (np.triu(products) == np.triu(big.T @ big)).all()


def plain(rows):
    """Kept rows, whole numbers, and the contract's values computed directly."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    far = [int(((n * row - s) ** 2).sum()) for row in x]
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return [i for i, _ in kept], far, centred, e[::-1], u[:, ::-1], cov


def check(got, rows, most=32):
    ids, far, centred, e, u, cov = plain(rows)
    wide = min(most, len(e))
    assert len(got) == len(ids) * wide
    assert {r.n for r in got} == {len(ids)} and max(r.identity_error for r in got) < 1e-9
    place = {i: k for k, i in enumerate(ids)}
    w = np.zeros((len(ids), wide))
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == far[place[r.vec_id]]
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(cov), rel_tol=1e-9)
    want = centred @ u[:, :wide] / np.sqrt(e[:wide])
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_whitening(spark, sf).collect(), rows)


def test_bad_rows_are_set_aside(spark, tmp_path):
    draw = np.random.default_rng(3)
    good = [(i, draw.normal(size=5).tolist()) for i in range(120)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    odd = [(204, []), (205, [1.0] * 4), (206, [1e300] * 5)]
    table_of(spark, good + bad + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path)).collect()
    assert {r.vec_id for r in got} == set(range(120))
    check(got, good)


def test_repeats_nulls_and_large_entries(spark):
    rows = [(None, [3.0e9, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-3.0e9, 0.0])]
    got = whitened(table_of(spark, rows)).collect()
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], object)
    far = [int(((4 * row - x.sum(axis=0)) ** 2).sum()) for row in x]
    assert sorted(int(r.deviation) for r in got) == sorted(far)
    assert sum(r.id == 1 for r in got) == 2 and sum(r.id is None for r in got) == 1


def test_no_variance_and_no_rows(spark):
    got = whitened(table_of(spark, [(i, [0.5, 0.5, 0.5]) for i in range(4)])).collect()
    assert [r.whitened for r in got] == [[None] * 3] * 4 and {r.deviation for r in got} == {0} and got[0].explained == [None] * 3
    few = whitened(table_of(spark, [(0, [0.0, 0.0, 1.0]), (1, [1.0, 0.0, 0.0])])).collect()
    assert [abs(round(r.whitened[0], 9)) for r in few] == [1, 1] and few[0].whitened[1:] == [None, None]
    assert whitened(table_of(spark, [])).count() == 0


def test_components_of_exact_numbers():
    values, axes, trace = components(2, [1, 1], [[1, 0], [0, 1]], 2)
    assert np.allclose(values, [0.5, 0]) and math.isclose(trace, 0.5)
    assert np.allclose(np.abs(axes[:, 0]), 2**-0.5)
