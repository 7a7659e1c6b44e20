import random

from shelfmatch.functions.text import contains_phrase
from shelfmatch.operators.phrases import phrases_in_texts


def test_phrases_match_one_by_one_search(spark):
    draw = random.Random(4)
    parts = ["a", "b", "ab", "é", "_", "-", "!", " ", " ", "1", "漢", "😀", "("]
    texts = [(i, "".join(draw.choices(parts, k=draw.randrange(40)))) for i in range(150)] + [(150, None), (151, ""), (152, "a b " * 20_000)]
    phrases = [(i, "".join(draw.choices(parts, k=draw.randint(1, 4)))) for i in range(120)] + [(120, ""), (121, None), (122, "a"), (123, "a"), (124, ".*")]
    t = spark.createDataFrame(texts, "doc_id long, text string")
    p = spark.createDataFrame(phrases, "item_id long, phrase string")
    want = {(r.doc_id, r.item_id) for r in t.crossJoin(p).where(contains_phrase(t["text"], p["phrase"], normalized=True)).collect()}
    assert (152, 122) in want and (152, 123) in want
    for sizes in ({}, {"phrase_chars": 40, "text_chars": 300}):
        got = [(r.doc_id, r.item_id) for r in phrases_in_texts(t, p, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nothing_to_find(spark):
    t = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "a")], "item_id long, phrase string")
    assert phrases_in_texts(t.limit(0), p).count() == 0 and phrases_in_texts(t, p.limit(0)).count() == 0
