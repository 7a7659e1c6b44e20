"""The mix: windows, deviation, wholeness and order."""

import pytest
from pyspark.sql import functions as F

from shelfmatch.llm.mixing import ADDED, in_order, mixed, places, schedule
from tests.llm.helpers import AWKWARD, documents


def slots(spark, parts):
    return schedule(spark.createDataFrame(parts, "__source string, __share int")).collect()


@pytest.mark.parametrize("parts", [[("a", 1)], [("a", 5), ("b", 3), (None, 1)], [("a", 30), ("b", 1), ("c", 1), ("d", 17)], [(str(i), i) for i in range(1, 12)]])
def test_every_block_in_its_window_and_deviation_below_one(spark, parts):
    found = slots(spark, parts)
    period = sum(n for _, n in parts)
    assert sorted(t for r in found for t in r["__slots"]) == list(range(period))
    for r in found:
        for i, t in enumerate(r["__slots"]):
            assert i * period // r["__share"] <= t < -(-(i + 1) * period // r["__share"])
        for t in range(period + 1):
            done = sum(x < t for x in r["__slots"])
            assert abs(done - t * r["__share"] / period) < 1


def test_whole_and_in_place(spark):
    rows = [(i, f"text {i}") for i in range(200)] + AWKWARD
    df = documents(spark, rows)
    found = mixed(df, block_rows=4, resolution=20, rows_per_band=16)
    got = found.collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    assert found.columns[: len(df.columns)] == df.columns
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert {None} < {r.source for r in got}


def test_given_weights_hold_until_a_source_ends(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "doc_id bigint, source string")
    got = sorted(mixed(df, weights={"a": 3.0, "b": 1.0}, resolution=4, block_rows=5).collect(), key=lambda r: r.mix_position)
    n_a = 0
    for k, r in enumerate(got[:260], 1):
        n_a += r.source == "a"
        assert abs(n_a - 0.75 * k) < 5


def test_order_and_empty(spark):
    df = documents(spark, [(i, str(i)) for i in range(100)])
    place = {r.doc_id: r.mix_position for r in mixed(df, block_rows=2).collect()}
    laid = in_order(df, block_rows=2).withColumn("part", F.spark_partition_id()).collect()
    assert [place[r.doc_id] for r in laid] == sorted(place.values())
    assert mixed(documents(spark, [])).count() == 0


def test_sources_without_weight_follow_after_the_others(spark):
    names = {"a": 50, "b": 23, "c": 12, None: 9}
    df = spark.createDataFrame([(i, s) for s, n in names.items() for i in range(n)], "doc_id bigint, source string")
    got = sorted(mixed(df, weights={"a": 2.0, "b": 1.0, "c": 0.0}, resolution=3, block_rows=5).collect(), key=lambda r: r.mix_position)
    assert len(got) == len({r.mix_position for r in got}) == 94
    assert all(r.source in ("a", "b") for r in got[:73]) and [r.source for r in got[73:]] == [None] * 9 + ["c"] * 12
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    equal = mixed(df, weights={}, block_rows=5).where("mix_slot < 4").select("source").distinct().count()
    assert equal == 4
    with pytest.raises(ValueError):
        mixed(df, weights={"a": -1.0})


def test_clashing_names(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 7, 8, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, mix_block int, __rank int, mix_place string")
    found = mixed(df, block_rows=4)
    assert found.columns == ["doc_id", "source", "__rank", "mix_place", *ADDED]
    assert found.where("__rank = 8").count() == 60 and found.agg(F.max("mix_block")).first()[0] == 7
    in_order(df, block_rows=4).write.parquet(f"{tmp_path}/laid")
    laid = spark.read.parquet(f"{tmp_path}/laid")
    assert laid.columns == df.columns and sorted(map(tuple, laid.collect())) == sorted(rows)
    placed = places(laid)
    assert placed.columns == ["doc_id", "source", "mix_block", "__rank", "mix_place"]
    position = {r.doc_id: r.mix_position for r in found.collect()}
    order = [r.doc_id for r in placed.orderBy("mix_place").collect()]
    assert order == sorted(position, key=position.get)
