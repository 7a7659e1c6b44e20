import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmatch import skew
from shelfmatch.operators import aggregates, windows


def events(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(500), i, rng.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t int, id long, v double")


def test_banded_rank_equals_row_number(spark):
    df = events(spark)
    got = skew.banded_rank(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 37))
    want = F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))
    assert got.withColumn("w", want).where("rank <> w").count() == 0
    whole = skew.banded_rank(df, [], [F.col("t"), F.col("id")], F.floor(F.col("t") / 37))
    assert [r["rank"] for r in whole.orderBy("t", "id").select("rank").collect()] == list(range(1, 3001))


def test_banded_previous_equals_window(spark):
    df = events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    got = skew.banded_previous(
        df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), {"m": "v"}, {"p": "t"}, {"f": "t"})
    bad = got.withColumns({
        "m2": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "p2": F.lag("t").over(w),
        "f2": F.min("t").over(Window.partitionBy("k")),
    }).where("not (m <=> m2 and p <=> p2 and f <=> f2)")
    assert bad.count() == 0


def test_exact_percentiles(spark):
    df = events(spark).select("k", F.round("v", 2).alias("v"))
    got = aggregates.exact_percentiles(df, "v", {"a": 0.5, "b": 0.95}, ["k"], 7)
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("x"), F.percentile("v", F.lit(0.95)).alias("y"))
    assert got.join(want, "k").where("abs(a - x) > 1e-9 or abs(b - y) > 1e-9").count() == 0
    assert got.count() == want.count()


def test_top_and_first(spark):
    df = events(spark)
    top = skew.top_per_key(df, ["k"], [F.desc("v"), F.col("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    first = skew.first_per_key(df, ["k"], [-F.col("v"), F.col("id")])
    assert first.join(top.where("rank = 1").select("k", F.col("id").alias("i")), "k").where("id <> i").count() == 0


def test_retain_jobs(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00" if i % 2 else None) for i in range(40)]
    jobs = spark.createDataFrame(rows, "job_id int, s string").select("job_id", F.to_timestamp("s").alias("completed_at"))
    kept = {r["job_id"] for r in windows.retain_jobs(jobs, "2024-01-01 00:59:00", 3000, 30).collect()}
    alive = [i for i in range(40) if i % 2 == 0 or i >= 9]
    drop = len(alive) - 29
    assert kept == set(alive) - set([i for i in alive if i % 2][:drop])


def test_range_rank_numbers_everything_though_one_value_is_common(spark):
    from shelfmatch.skew import quantile_band, range_rank

    rows = [(5 if i % 3 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "v int, id int")
    got = {r["id"]: r["n"] for r in range_rank(df, [F.col("v"), F.col("id")], "n").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}
    assert range_rank(df.limit(0), [F.col("v"), F.col("id")], "n").count() == 0
    tiny = spark.createDataFrame([(i / 1e6,) for i in range(500)], "v double")
    bands = sorted((r["v"], r["b"]) for r in tiny.withColumn("b", quantile_band(tiny, F.col("v"), 10)).collect())
    assert [b for _, b in bands] == sorted(b for _, b in bands) and len({b for _, b in bands}) == 10


def test_percentiles_inside_one_unit(spark):
    from shelfmatch.operators.aggregates import exact_percentiles

    values = [i / 1000 for i in range(997)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    row = exact_percentiles(df, "ms", {"p50": 0.5, "p95": 0.95}).first()
    ordered = sorted(values)
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        at = q * (len(ordered) - 1)
        low = int(at)
        assert abs(row[name] - (ordered[low] + (ordered[low + 1] - ordered[low]) * (at - low))) < 1e-12
