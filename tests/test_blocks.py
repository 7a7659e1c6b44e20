import random

from pyspark.sql import functions as F

from shelfmatch.operators import blocks as B
from shelfmatch.operators import joins as J
from shelfmatch.operators import ranking as R

BOX = "box struct<min_x:double,min_y:double,max_x:double,max_y:double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def brute_dedupe(rows):
    kept = []
    for r in rows:
        i = next((i for i, k in enumerate(kept) if k[1] == r[1] and (
            k[3] is None or r[3] is None or iou(k[3], r[3]) >= 0.6)), None)
        if i is None:
            kept.append(r)
        elif (-1 if r[2] is None else r[2]) > (-1 if kept[i][2] is None else kept[i][2]):
            kept[i] = r
    return kept


def test_duplicate_blocks_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for image in range(6):
        for _ in range(400 if image == 0 else 40):
            box = None if rng.random() < 0.1 else [rng.randrange(0, 60, 5), rng.randrange(0, 30, 5)]
            if box:
                box = [float(box[0]), float(box[1]), box[0] + 40.0 + rng.randrange(3) * 5, box[1] + 20.0]
            rows.append([image, rng.choice(["a", "b", "c"]), rng.choice([None, 0.2, 0.5, 0.9, 0.95]), box])
    ordered = []
    for image in range(6):
        mine = [r for r in rows if r[0] == image]
        mine.sort(key=lambda r: ((r[3][1], r[3][0]) if r[3] else (1e9, 1e9), r[1]))
        ordered += [(image, r[1], r[2], r[3], n) for n, r in enumerate(mine, 1)]
    df = spark.createDataFrame(
        [(i, t, c, tuple(b) if b else None, n) for i, t, c, b, n in ordered],
        f"image_id int, normalized_text string, confidence double, {BOX}, pos long")
    got = sorted((r["image_id"], r["pos"]) for r in B.duplicate_blocks(df).collect())
    want = sorted((r[0], r[4]) for image in range(6) for r in brute_dedupe([o for o in ordered if o[0] == image]))
    assert got == want


def test_a_hundred_thousand_equal_boxes_are_one(spark):
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((0.0, "min_x"), (0.0, "min_y"), (9.0, "max_x"), (9.0, "max_y"))])
    rows = spark.range(1, 100_001).select(
        F.lit(1).alias("image_id"), F.lit("a").alias("normalized_text"), (F.col("id") % 1000 / 1000).alias("confidence"), box.alias("box"), F.col("id").alias("pos"))
    assert [(r.pos, r.confidence) for r in B.duplicate_blocks(rows).collect()] == [(999, 0.999)]


def test_runs_cross_bands(spark):
    """Touching rows chain over many bands; a gap begins a new run."""
    rows = [(1, float(y), y + (300.0 if y < 2000 or y > 2400 else 50.0), y) for y in range(0, 4000, 200)]
    df = spark.createDataFrame(rows, "k int, low double, high double, pos long")
    runs = B.connected_runs(df, ["k"], F.col("low"), F.col("high"), F.floor(F.col("low") / 256), "run")
    found, reach, want = {r.pos: r.run.pos for r in runs.collect()}, -1.0, {}
    for _, low, high, pos in rows:
        start = pos if low >= reach else start  # noqa: F821
        reach, want[pos] = max(reach, high), start
    assert found == want and len(set(want.values())) > 1


def test_boxes_without_area_all_stay_whatever_their_number(spark):
    for n in (64, 65, 1000):
        flat = [(1, "a", 0.5, (3.0, 3.0, 3.0, 9.0), i) for i in range(1, n + 1)]
        more = [(1, "a", 0.9, None, n + 1), (2, "a", 0.4, (0.0, 0.0, 9.0, 9.0), 1), (2, "a", 0.8, None, 2), (2, "a", 0.8, None, 3)]
        df = spark.createDataFrame(flat + more, f"image_id int, normalized_text string, confidence double, {BOX}, pos long")
        rows = B.duplicate_blocks(df).collect()
        assert sum(r["image_id"] == 1 for r in rows) == n
        assert [(r["pos"], r["confidence"]) for r in rows if r["image_id"] == 2] == [(2, 0.8)]
        assert sorted(r["pos"] for r in rows if r["image_id"] == 1) == [*range(2, n + 1), n + 1]


def scattered(rng, image, n):
    """Blocks of three texts; some without a box, some without area, many equal boxes."""
    for seq in range(n):
        box = None if rng.random() < 0.1 else (float(rng.randrange(0, 60, 5)), float(rng.randrange(0, 30, 5)))
        if box:
            box = (*box, box[0] + rng.choice([0.0, 40.0, 45.0, 50.0]), box[1] + 20.0)
        yield image, rng.choice(["a", "b", "c"]), rng.choice([None, 0.2, 0.5, 0.9, 0.95]), box, seq


def read_in_order(rows):
    return sorted(rows, key=lambda r: ((r[3][1], r[3][0]) if r[3] else (1e9, 1e9), r[1], r[4]))


BLOCK = f"image_id int, normalized_text string, confidence double, {BOX}, seq long"


def test_small_groups_are_neither_swept_nor_numbered(spark, monkeypatch):
    def swept(*_):
        raise AssertionError("a small group was swept or numbered")

    monkeypatch.setattr(B, "connected_runs", swept)
    rng = random.Random(17)
    rows = [r for image in range(30) for r in scattered(rng, image, 2 + image)] + [(None, "a", 0.5, None, 0), (None, "a", 0.7, None, 1), (None, None, 0.1, None, 2)]
    want = sorted((r[0] or 0, r[4]) for image in (*range(30), None) for r in brute_dedupe(read_in_order([r for r in rows if r[0] == image and r[1]])))
    want = sorted([*want, (0, 2)])
    df = spark.createDataFrame(rows, BLOCK)
    numbered = B.duplicate_blocks(R.reading_order(df))
    assert sorted((r["image_id"] or 0, r["seq"]) for r in numbered.collect()) == want
    plain = B.duplicate_blocks(df, order=swept)
    assert sorted((r["image_id"] or 0, r["seq"]) for r in plain.collect()) == want and plain.columns == df.columns


def test_small_and_large_groups_follow_one_rule(spark):
    rng = random.Random(19)
    rows = [r for image in range(6) for r in scattered(rng, image, 3 * B.FEW_COPIES + 100 if image == 2 else 60)]
    want = sorted((r[0], r[4]) for image in range(6) for r in brute_dedupe(read_in_order([r for r in rows if r[0] == image])))
    numbered = []
    order = lambda df: (numbered.append(df.select("image_id").distinct().collect()), R.reading_order(df))[1]
    got = B.duplicate_blocks(spark.createDataFrame(rows, BLOCK), order=order).collect()
    assert sorted((r["image_id"], r["seq"]) for r in got) == want
    assert [[r["image_id"] for r in images] for images in numbered] == [[2]]


def test_grid_pairs_equal_direct_pairs(spark):
    rng = random.Random(11)
    rows = []
    for n in range(300):
        x, y = rng.uniform(0, 900), rng.uniform(0, 700)
        w, h = rng.uniform(10, 150), rng.uniform(4, 60)
        rows.append((1, "full", n, rng.choice([None, 0.6, 0.8, 0.9]), (x, y, x + w, y + h)))
    df = spark.createDataFrame(rows, f"image_id int, variant string, pos long, confidence double, {BOX}")
    grid = sorted(tuple(r) for r in J.joinable_blocks(df).collect())
    sized = J._sized_boxes(df, []).withColumn("__cell", F.lit(0))
    every = J._side(sized, "l", []).join(J._side(sized, "r", []), ["image_id", "variant"]).where(J._line_test() | J._stack_test())
    direct = every.select(
        "image_id", "variant", F.least("l_pos", "r_pos"), F.greatest("l_pos", "r_pos"), F.when(J._line_test(), "line").otherwise("stack"))
    assert grid == sorted(tuple(r) for r in direct.collect())
    assert {p[4] for p in grid} == {"line", "stack"}


def test_blocks_of_small_images_meet_without_a_grid(spark):
    """Sixty images on both sides of the bound: the same pairs, and no block of a small image is copied to cells."""
    rng, rows = random.Random(13), []
    for image in range(60):
        for n in range(J.FEW_BLOCKS + (1 if image == 7 else -56)):
            x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 200), rng.uniform(10, 150), rng.uniform(4, 60)
            rows.append((None if image == 9 else image, "full", n, rng.choice([None, 0.6, 0.8, 0.9]), (x, y, x + w, y + h)))
    df = spark.createDataFrame(rows, f"image_id int, variant string, pos long, confidence double, {BOX}")
    found = J.joinable_blocks(df)
    sized = J._sized_boxes(df, [])
    every = J._side(sized, "l", []).join(J._side(sized, "r", []), ["image_id", "variant"]).where(J._line_test() | J._stack_test())
    direct = every.select(
        "image_id", "variant", F.least("l_pos", "r_pos"), F.greatest("l_pos", "r_pos"), F.when(J._line_test(), "line").otherwise("stack"))
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(tuple(r) for r in direct.collect()) and {7} < {r[0] for r in rows}
    cells = J.joinable_blocks(df.where("image_id <> 7"))
    cells.collect()
    final = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate explode" not in final


def label(spark, rows):
    return spark.createDataFrame(rows, f"image_id int, variant string, pos long, text string, {BOX}, confidence double")


def test_candidate_name(spark):
    rows = [
        (1, "full", 1, "Ignored Title", (100.0, 0.0, 300.0, 90.0), 0.99),
        (1, "central_crop", 2, "Красная", (120.0, 100.0, 280.0, 140.0), 0.9),
        (1, "central_crop", 3, "Горка", (125.0, 145.0, 275.0, 185.0), 0.92),
        (1, "central_crop", 4, "сухое", (100.0, 200.0, 300.0, 260.0), 0.99),
        (2, "full", 1, "Edge", (0.0, 0.0, 50.0, 40.0), 0.95),
        (2, "full", 2, "Low Confidence", (150.0, 0.0, 250.0, 40.0), 0.5),
        (3, "full", 1, "Huge Title", (100.0, 0.0, 300.0, 120.0), 0.6),
        (3, "full", 2, "small", (150.0, 130.0, 250.0, 150.0), 0.8),
    ]
    images = spark.createDataFrame([(i, 400) for i in (1, 2, 3)], "image_id int, width int")
    got = {r["image_id"]: r for r in B.candidate_name(label(spark, rows), images).collect()}
    assert got[1]["name"] == "Красная Горка" and got[1]["block_count"] == 2 and got[1]["confidence"] == 0.9
    assert 2 not in got
    assert got[3]["name"] == "Huge Title"


def test_an_earlier_copy_leads_where_pairs_score_alike(spark):
    """Blocks 1 and 3 are copies; the pair of 1 and 4 scores as that of 3 and 4, and as that of 2 and 4 does."""
    first, second = (100.0, 0.0, 195.0, 40.0), (205.0, 0.0, 300.0, 40.0)
    images = spark.createDataFrame([(1, 400)], "image_id int, width int")
    for other, name in ((2, "Alpha Gamma"), (0, "Delta Gamma")):
        rows = [
            (1, "full", 1, "Alpha", first, 0.8), (1, "full", other, "Delta", first, 0.9), (1, "full", 3, "Alpha", first, 0.9),
            (1, "full", 4, "Gamma", second, 0.8), (1, "full", 5, "Gamma", second, 0.8),
        ]
        best = B.candidate_name(label(spark, rows), images).collect()
        assert [(r["name"], r["block_count"]) for r in best] == [(name, 2)]


def test_candidate_fields_keep_best_source(spark):
    rows = [(1, 1, "урожай 2019 0,75 л", 0.5), (1, 2, "2019 13%", 0.9), (1, 3, "основан в 1905", 0.99), (1, 4, "2020", None)]
    df = spark.createDataFrame(rows, "image_id int, pos long, normalized_text string, confidence double")
    fields = B.candidate_fields(df)
    got = {(r["field_type"], r["normalized_value"]): r["confidence"] for r in fields.collect()}
    assert got == {("year", "2019"): 0.9, ("volume", "0.75 l"): 0.5, ("percentage", "13%"): 0.9, ("year", "1905"): 0.99, ("year", "2020"): None}
    assert B.vintage_evidence(fields).first()["years"] == [2019]


def test_build_blocks(spark):
    rows = [("i", "full", 1, " Мерло ", (0.0, 50.0, 10.0, 60.0), 0.5), ("i", "central_crop", 2, "мерло", (0.0, 50.0, 10.0, 60.0), 0.9),
            ("i", "full", 3, "Top", (0.0, 0.0, 10.0, 10.0), 0.4), ("i", "full", 4, "  ", None, 0.4)]
    df = spark.createDataFrame(rows, f"image_id string, variant string, seq long, text string, {BOX}, confidence double")
    out = B.build_blocks(df).orderBy("pos").collect()
    assert [(r["text"], r["confidence"]) for r in out] == [("Top", 0.4), ("мерло", 0.9)]
    assert B.build_blocks(df).where(F.col("box").isNull()).count() == 0
