import json

from pyspark.sql import functions as F

from shelfmatch import udfs
from shelfmatch.functions import page as G
from shelfmatch.operators import aggregates as A


def embedder():
    def embed(batch):
        if (batch["uri"] == "bad").any():
            raise ValueError("cannot decode")
        return [[float(len(u)), 1.0] for u in batch["uri"]]

    return embed


def test_embed_keeps_bad_rows_as_errors(spark):
    df = spark.createDataFrame([("aa",), ("bad",), ("cccc",), ("aa",)], "uri string")
    rows = udfs.embed(df.coalesce(1), embedder, "m", batch_size=3).collect()
    assert sorted((r["uri"], tuple(r["embedding"] or ()), r["error"]) for r in rows) == [
        ("aa", (2.0, 1.0), None), ("aa", (2.0, 1.0), None), ("bad", (), "ValueError: cannot decode"), ("cccc", (4.0, 1.0), None)]
    once = udfs.embed(df.withColumn("n", F.monotonically_increasing_id()), embedder, "m", same_input="uri")
    assert once.count() == 4 and once.where("error is null").select("model_name").distinct().collect()[0][0] == "m"


def test_text_photo_and_variant_hooks(spark):
    images = spark.createDataFrame([("i", "central_crop", 10.0, 5.0), ("j", "full", 0.0, 0.0)], "image_id string, variant string, origin_x double, origin_y double")

    def reader():
        def read(batch):
            if (batch["image_id"] == "j").any():
                raise RuntimeError("no")
            return [[{"text": "A", "confidence": 0.5, "bbox": [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]}] for _ in range(len(batch))]

        return read

    blocks, failed = udfs.recognize_text(images, reader)
    assert blocks.first()["box"].asDict() == {"min_x": 11.0, "min_y": 7.0, "max_x": 13.0, "max_y": 9.0}
    assert failed.count() == 1
    pairs = udfs.match_photos(spark.createDataFrame([(1, "u")], "query_id int, image_uri string"), lambda: lambda b: [
        {"matches": 20, "inliers": 15, "scores": [0.5, 0.25]} for _ in range(len(b))])
    assert pairs.first()["mean_match_score"] == 0.375 and pairs.first()["inliers"] == 15
    out = udfs.predict_variants(spark.createDataFrame([("s", "A")], "sample_id string, variant string"), lambda: lambda b: [
        {"full_text": "t", "name": "n", "producer": "p", "year": "y"} for _ in range(len(b))])
    assert out.first()["prediction"]["name"] == "n" and out.first()["status"] == "ok"


def test_card_pages(spark):
    ld = json.dumps({"@graph": [{"@type": "WebSite", "name": "Shop"}, {"@type": "Product", "name": "Мерло &amp; Ко", "image": {"url": "/ld.jpg"}}]})
    pages = {
        1: f'<html><h1>Other</h1><script type="application/ld+json">{ld}</script><img class="card__bottle x" data-src="b.jpg" src="s.jpg"></html>',
        2: f'<script type="application/ld+json">{ld}</script><img alt="Мерло & Ко бутылка" src="exact.jpg">',
        3: '<h1> Name <b>Bold</b>: </h1><img alt="name bold front" src="https://x/exact.jpg"><meta property="og:image" content="og.jpg">',
        4: '<h1>Zed</h1><meta property="og:image" content="og.jpg"><img alt="red wine" src="g.jpg">',
        5: '<h1>N</h1><img alt="вино" srcset="a.jpg 1x, b.jpg 2x"><img alt="x" src="no.jpg">',
        6: '<h1>N</h1><p>Пройдите КАПЧА</p><meta property="og:image" content="og.jpg">',
        7: '<h1>N &amp; M</h1><script type="text/javascript">captcha</script><p>text</p>',
        8: '<meta name="twitter:title" content="T"><img alt="wine" src="data:abc">',
    }
    df = spark.createDataFrame([(i, "https://shop.example.org/c/1", h) for i, h in pages.items()], "page_id int, url string, html string")
    got = {r["page_id"]: (r["name"], r["image_url"], r["reason"]) for r in G.page_facts(df).collect()}
    base = "https://shop.example.org"
    assert got[1] == ("Мерло & Ко", f"{base}/c/b.jpg", None)
    assert got[2] == ("Мерло & Ко", f"{base}/ld.jpg", None)
    assert got[3] == ("Name Bold", "https://x/exact.jpg", None)
    assert got[4] == ("Zed", f"{base}/c/og.jpg", None)
    assert got[5] == ("N", f"{base}/c/a.jpg", None)
    assert got[6][1:] == (None, "challenge_page")
    assert got[7] == ("N & M", None, "no_product_image")
    assert got[8] == ("T", None, "no_product_image")
    plain = df.where("page_id = 4").withColumn("html", F.lit("<h1 class='t'>A  &lt;<i>B</i></h1>"))
    assert G.page_name(plain).first()["name"] == "A < B"


def test_pages_are_dealt_over_tasks_and_need_two_python_steps(spark):
    """Each Python step holds a worker per running task, and a small file of pages is one task."""
    pages = spark.createDataFrame([(i, "https://shop.example.org/", f"<h1>N{i} &amp; M</h1>") for i in range(400)], "page_id int, url string, html string").coalesce(1)
    for read in (G.page_name, G.page_image, G.challenge_page):
        found = read(pages)
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_palette(spark):
    rows = [(1, 255, 0, 0, 255)] * 30 + [(1, 0, 0, 0, 255)] * 10 + [(1, 255, 255, 255, 0)] * 10 + [(2, 255, 0, 0, 255)] * 23 + [(3, 250, 250, 250, 255)] * 12 + [(3, 100, 100, 100, 255)] * 12
    df = spark.createDataFrame(rows, "image_id int, red int, green int, blue int, alpha int")
    got = {r["image_id"]: r["bins"] for r in A.palette_histogram(df).collect()}
    assert got[2] is None and got[3][12] == 0.5 and got[3][13] == 0.5
    assert [round(x, 6) for x in got[1]] == [0.6, 0.2] + [0.0] * 9 + [0.2, 0.0, 0.0]
