"""Quality rules and the quality model."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmatch.llm import quality_rules as R
from shelfmatch.llm.quality_model import WIDTH, Model, fit, passages, scored
from tests.llm.helpers import AWKWARD, WORDS, documents


def counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


def texts(seed=1):
    draw = random.Random(seed)
    rows = list(AWKWARD)
    for i in range(20, 60):
        words = [draw.choice(["a", "bb", "cé", "d&", "漢"]) for _ in range(draw.randint(0, 40))]
        rows.append((i, "".join(w + draw.choice([" ", "\n", "\t ", "  "]) for w in words)))
    return rows


def labelled(spark, n=300):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(draw.randint(20, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + draw.choice(["###", "&&&"]) for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def test_statistics_and_base_rule(spark):
    rows = texts()
    found = R.quality_verdicts(documents(spark, rows), no_labels(spark)).collect()
    got = sorted((str(r.doc_id), tuple(r[1:6]), r.base_failed, r.kept) for r in found)
    want = []
    for i, t in rows:
        c = counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((str(i), c, failed, not failed))
    assert got == sorted(want)


def test_learned_list_rejects_bad_and_keeps_good(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    rules = R.learn_from(docs, labels)
    assert rules and all(0 < c.threshold < 1 for c in rules[0])
    kept = {r.doc_id: r.kept for r in R.quality_verdicts(docs, labels).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in kept)
    stay = R.keep_good(docs, labels)
    assert stay.columns == docs.columns and stay.count() == sum(kept.values())


def test_labels_of_one_kind_null_or_contradictory_teach_nothing(spark):
    docs = documents(spark, labelled(spark, 60)[0])
    one = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(None, 0), (1, None), (5, 0), (5, 1)], "doc_id bigint, quality int")
    assert R.learn_from(docs, one) == R.learn_from(docs, odd) == []
    assert R.quality_verdicts(documents(spark, []), no_labels(spark)).count() == 0


def test_passages_cover_whole_texts():
    rows = passages(("word " * 1000 + "#### " * 10).encode())
    assert rows.shape == (16, WIDTH) and rows[-1, 7] > 0.15 and rows[0, 7] == 0
    assert passages(None).shape == passages(b" \n ").shape == (1, WIDTH)


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    model = Model(6)
    rows, starts, labels = draw.normal(size=(9, 6)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    def loss():
        y = model.forward(rows, starts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))
    grads = model.gradients(model.forward(rows, starts), labels, starts)
    for name, values in model.p.items():
        at = tuple(0 for _ in values.shape)
        values[at] += 1e-6
        high = loss()
        values[at] -= 2e-6
        low = loss()
        values[at] += 1e-6
        assert grads[name][at] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_model_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    found = scored(docs, fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    own = [r for r in found if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in own) >= 0.95 * len(own)


def test_model_awkward(spark):
    docs = documents(spark, AWKWARD)
    found = scored(docs, fit(docs, no_labels(spark))).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert scored(documents(spark, []), Model(WIDTH)).count() == 0


def test_clashing_names_and_rows_of_every_kind(spark):
    good = "these are plain words of a text that nobody would reject at all today"
    rows = [(1, good, 1, "a", 2.5), (1, good, 1, "a", 2.5), (2, None, 2, "b", 0.0), (3, " ", 3, "c", 0.0), (None, good + " or later", 4, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __stats int, __kept string, __f_symbol_share double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    kept = R.keep_good(df, none)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [rows[0], rows[1], rows[4]]
    judged = R.judged(df, [])
    assert judged.columns == ["doc_id", "text", "__f_symbol_share", "__stats", "__base_failed", "__rule", "__kept"]
    assert judged.where("__kept").count() == 3 and R.keep_good(df.limit(0), none).count() == 0
