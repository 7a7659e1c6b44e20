from pyspark.sql import functions as F

from shelfmatch.functions import text as X


def one(spark, value, function):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(function(F.col("s")).alias("r")).first()["r"]


def test_normalize_text(spark):
    cases = {
        "  Ｆｕｌｌ Width ": "full width", "STRASSE Straße": "strasse strasse", "Ёлка\t\n 1": "ёлка 1", "ﬁne": "fine",
        "ΣΑΣ": "σασ", "": "", "a  b": "a b",
    }
    for given, wanted in cases.items():
        assert one(spark, given, X.normalize_text) == wanted
    assert one(spark, None, X.normalize_text) is None


def test_tokens_and_fields(spark):
    assert one(spark, "мерло 2019 13,5% d'or 0.75l", X.tokenize) == ["мерло", "2019", "13,5%", "d'or", "0.75", "l"]
    assert one(spark, "12019 1999/2020 20191", X.extract_years) == ["1999", "2020"]
    percent = one(spark, "13,5 % и 1234%", X.extract_percentages)
    assert [(p["value"], p["normalized_value"]) for p in percent] == [("13,5%", "13.5%")]
    volume = one(spark, "0,75 Л 750мл 75cl 5 lb", X.extract_volumes)
    assert [v["normalized_value"] for v in volume] == ["0.75 l", "750 ml", "75 cl"]


def test_repair_lookalikes(spark):
    assert one(spark, "mockва 2019 wine ab", X.repair_lookalikes) == "москва 2019 wine ab"
    df = spark.createDataFrame([("cухое вино", "kpacное")], "t string, n string")
    assert df.select(X.embedding_query_text(F.col("t"), F.col("n"))).first()[0] == "красное сухое вино"
    assert df.select(X.embedding_query_text(F.col("t"), F.lit(None).cast("string"))).first()[0] == "сухое вино"


def test_word_set(spark):
    assert sorted(one(spark, "Ёлка ёлка BRUT br 12abc", X.word_set)) == ["abc", "brut", "елка"]


def test_photo_key(spark):
    assert one(spark, "up/thumbnail_Щука Яблоко_0123456789.JPG", X.photo_key) == "shchukayabloko"
    assert one(spark, "a/Chateau-1.2.png", X.photo_key) == "chateau12"


def test_clean_name(spark):
    for rejected in ("2019", "ab", "Вино", "ЗГУ Кубань", "Российское вино премиум", "x" * 61):
        assert one(spark, rejected, X.clean_name) == ""
    assert one(spark, "- Красная Горка 2019 -", X.clean_name) == "Красная Горка"


def test_contains_phrase(spark):
    rows = [
        ("Сорт Мерло, 2019", "мерло", True), ("мерлоне", "мерло", False), ("a (b) c", "(b)", True), ("x \\E y", "\\E", True),
        ("a.c", "abc", False), ("anything", " ", False), ("a  B c", "b C", True),
    ]
    df = spark.createDataFrame(rows, "t string, p string, w boolean")
    assert df.where(X.contains_phrase(F.col("t"), F.col("p")) != F.col("w")).count() == 0


def test_character_error_rate(spark):
    rows = [("", "", 0.0), ("", "x", 1.0), ("кот", "кит", 1 / 3), ("ABC", "abc", 0.0)]
    df = spark.createDataFrame(rows, "t string, p string, w double")
    got = df.select(X.character_error_rate(F.col("t"), F.col("p")).alias("c"), "w").collect()
    assert all(abs(r["c"] - r["w"]) < 1e-12 for r in got)


def test_chunks(spark):
    assert one(spark, " a  b c d e", lambda c: X.chunk_words(c, 2)) == ["a b", "c d", "e"]
    assert one(spark, " a  b", lambda c: X.chunk_words(c, 2)) == [" a  b"]
    assert one(spark, "  ", lambda c: X.chunk_words(c, 2)) == []
    chunker = X.chunk_by_tokens(6, len)
    assert one(spark, "ab cd efg h", chunker)["chunks"] == ["ab cd", "efg h"]
    assert one(spark, "ab toolong1", chunker)["error"] is not None


def test_normalize_slug(spark):
    url = "https://catalog.example.org/items"
    cases = {
        "  ": (None, True), "abc-1": ("abc-1", True), f"{url}/abc/": ("abc", True), f"{url}/a?x=1": (None, False),
        "http://other/abc": (None, False), "ABC": (None, False), "-a": (None, False),
    }
    for given, wanted in cases.items():
        got = one(spark, given, lambda c: X.normalize_slug(c, url))
        assert (got["slug"], got["valid"]) == wanted, given
