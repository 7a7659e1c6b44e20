"""Ids of all items of a query's model."""

import numpy as np

import __spark_entry__ as entry
from shelfmatch.operators import knn
from tests.test_odd_texts import equals_sql


def vectors(spark, items):
    """Two vectors per item; ``visual-b`` has all items but seven."""
    drawn = np.random.default_rng(5).normal(size=(2 * items, 64))
    return spark.createDataFrame(
        [(i, [float(x) for x in v], i % items) for i, v in enumerate(drawn)], "vec_id long, embedding array<float>, label int")


def test_top_ids_leave_no_item_out(spark, tmp_path):
    equals_sql(spark, tmp_path, "top_ids", "embeddings", vectors(spark, 40))
    ids = [r["ids"].split(",") for r in entry.queries()["top_ids"](spark, str(tmp_path)).collect()]
    assert {len(set(x)) for x in ids} == {len(x) for x in ids} == {7, 33}


def test_cells_that_return_all_items_are_bounded(spark, monkeypatch):
    df = vectors(spark, 40)
    monkeypatch.setattr(knn, "CELL_WINNERS", 400)
    assert knn._blocks(df, df, "embedding", knn.BLOCK_BYTES) == (1, 1)
    q_blocks, r_blocks = knn._blocks(df, df, "embedding", knn.BLOCK_BYTES, 80)
    assert 80 * 80 / (q_blocks * r_blocks) <= 400
