"""Stupid-backoff scores against counting in Python."""

import math
from collections import Counter

import pytest

from shelfmatch.llm.ngram_scores import backoff_scores
from tests.llm.helpers import AWKWARD, WORDS, documents


def brute(rows, order):
    docs = [WORDS.findall(t or "") for _, t in rows]
    grams = lambda words, n: Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    own = [[grams(w, n) for n in range(1, order + 1)] for w in docs]
    total = [sum((o[n] for o in own), Counter()) for n in range(order)]
    words = sum(map(len, docs))
    out = []
    for (i, _), doc, mine in zip(rows, docs, own):
        other = lambda g, mine=mine: total[len(g) - 1][g] - mine[len(g) - 1][g]
        rest, score = max(1, words - len(doc)), 0.0
        for at in range(len(doc)):
            penalty = 0.0
            for n in range(min(order, at + 1), 0, -1):
                gram = tuple(doc[at - n + 1 : at + 1])
                if other(gram) > 0:
                    score += penalty + math.log(other(gram) / (other(gram[:-1]) if n > 1 else rest))
                    break
                penalty += math.log(0.4)
            else:
                score += penalty - math.log(rest)
        out.append((str(i), len(doc), pytest.approx(score, abs=1e-6)))
    return sorted(out, key=lambda r: r[:2])


ROWS = [*((i, t) for i, t in AWKWARD if t is None or len(t) < 1000), (20, "a b a b c"), (21, "a b c d"), (22, "b a b"), (23, "one two a b")]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block, bucket", [(4_000_000, 3_000_000), (20, 5)])
def test_scores(spark, order, block, bucket):
    found = backoff_scores(documents(spark, ROWS), order=order, chars_per_block=block, grams_per_bucket=bucket).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.score) for r in found), key=lambda r: r[:2]) == brute(ROWS, order)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in found)


def test_no_documents_and_long_texts(spark):
    assert backoff_scores(documents(spark, [])).count() == 0
    assert [r.n_words for r in backoff_scores(documents(spark, [AWKWARD[5]])).collect()] == [60_000]
