"""Near copies of the pipeline against brute force on edited copies."""

import random

import numpy as np
import pytest

from shelfmatch.llm import near_copies
from shelfmatch.llm.near_copies import keep_one, shingles, similarity
from tests.llm.helpers import AWKWARD, LONG, documents


def edited(draw, words, share):
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


def test_edited_copies_are_found_and_others_stay(spark):
    draw = random.Random(4)
    rows, close, far = [], set(), set()
    for i in range(300):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 400))]
        copy = " ".join(edited(draw, words, [0, 0.01, 0.02, 0.06][i % 4]))
        text = " ".join(words)
        rows += [(i, text), (1000 + i, copy)]
        like = similarity(shingles(text.encode(), 5), shingles(copy.encode(), 5))
        (close if like >= 0.8 else far).add(1000 + i)
    stay = {r.doc_id for r in keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert len(close) > 200 and len(far) > 40
    assert set(range(300)) | far <= stay
    assert len(close & stay) <= len(close) * 0.005


def closure(sets, least=0.8):
    """Smallest identifier of each group, from all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if find(a) != find(b) and similarity(sets[a], sets[b]) >= least:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def test_links_beside_the_leader_are_kept(spark):
    """In each triple x is close to both others, which are not close to each other."""
    draw = random.Random(6)
    rows, want = [], set()
    for g in range(200):
        base = [f"g{g}w{i}" for i in range(400)]
        lead, x, y = list(base), list(base), list(base)
        for at in draw.sample(range(16, 200, 8), 8):
            y[at] = f"y{draw.randrange(10**6)}"
        for at in draw.sample(range(216, 392, 8), 2):
            lead[at] = f"l{draw.randrange(10**6)}"
        sets = [shingles(" ".join(t).encode(), 5) for t in (lead, x, y)]
        order = draw.sample(range(3), 3)
        rows += [(10 * g + place, " ".join(t)) for place, t in zip(order, (lead, x, y))]
        assert similarity(sets[0], sets[1]) >= 0.8 and similarity(sets[1], sets[2]) >= 0.8 > similarity(sets[0], sets[2])
        want.add(10 * g)
    stay = {r.doc_id for r in keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert want <= stay and len(stay - want) <= 2


@pytest.mark.parametrize("crowded", [3, 64])
def test_large_groups_match_the_closure_of_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    draw = random.Random(crowded)
    rows = []
    for g, size in enumerate([500, 120]):
        base = [f"g{g}w{i}" for i in range(200)]
        # From nearly equal to just at the threshold: pairs fall on both sides of it.
        rows += [(1000 * g + i, " ".join(edited(draw, base, draw.choice([0.005, 0.01, 0.02, 0.03])))) for i in range(size)]
    rows += [(5000 + i, " ".join(f"a{draw.randrange(10**5)}" for _ in range(100))) for i in range(50)]
    draw.shuffle(rows)
    want = closure({i: shingles(t.encode(), 5) for i, t in rows})
    stay = {r.doc_id for r in keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert want <= stay and len(stay - want) <= 0.01 * len(rows)


def test_texts_that_share_a_template_stay(spark):
    draw = random.Random(9)
    template = [f"t{i}" for i in range(150)]
    rows = [(i, " ".join(template + [f"own{draw.randrange(10**6)}" for _ in range(90)])) for i in range(300)]
    assert keep_one(documents(spark, rows)).count() == 300


def test_sketches_do_not_rule_out_close_pairs():
    draw = random.Random(10)
    lost = 0
    for _ in range(300):
        words = [f"w{draw.randrange(9999)}" for _ in range(300)]
        a, b = (shingles(" ".join(w).encode(), 5) for w in (words, edited(draw, words, 0.02)))
        if similarity(a, b) >= 0.8:
            x, y = (np.frombuffer(near_copies.sketch(near_copies.minima(s)), np.uint8) for s in (a, b))
            lost += (x == y).sum() < near_copies.fewest_equal(0.8)
    assert not lost


def test_awkward_rows(spark):
    stay = keep_one(documents(spark, AWKWARD))
    found = sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)
    want = [(1, "one two  three"), (3, None), (6, AWKWARD[5][1]), (9, AWKWARD[-1][1]), (None, "only here without a name")]
    assert found == sorted(want, key=str)
    assert keep_one(documents(spark, [])).count() == 0


def test_least_hashes_rule_out_only_pairs_below(monkeypatch):
    monkeypatch.setattr(near_copies, "KEPT", 256)
    draw = random.Random(12)
    texts = []
    for n in (3, 40, 200, 900, 5000):
        base = [f"n{n}w{draw.randrange(9999)}" for _ in range(n)]
        texts += [" ".join(edited(draw, base, share)) for share in (0, 0, 0.01, 0.02, 0.04, 0.1)]
    sets = [shingles(t.encode(), 5) for t in [*texts, ""]]
    may = near_copies.alike([near_copies.least_hashes(s) for s in sets], 0.8)
    true = np.array([[similarity(a, b) for b in sets] for a in sets])
    assert may[(true >= 0.8) & ~np.eye(len(sets), dtype=bool)].all()
    whole = np.array([len(s) < 256 for s in sets])
    assert not may[(true < 0.75) & whole[:, None] & whole & (np.array([len(s) for s in sets]) > 30)].any()
    assert not may[true < 0.5][np.add.outer(*[np.array([len(s) for s in sets])] * 2)[true < 0.5] > 60].any()


@pytest.mark.parametrize("side", [2, 5, 64])
def test_every_pair_of_different_roots_meets_in_a_cell(spark, monkeypatch, side):
    monkeypatch.setattr(near_copies, "SIDE", side)
    draw = random.Random(side)
    rows = [(k, k * 100 + n, k * 100 + draw.choice([0, 0, 0, n])) for k, size in ((1, 2), (2, 9), (3, 60)) for n in range(size)]
    rows += [(4, 400 + n, 400) for n in range(20)]
    cells = {}
    for r in near_copies._dealt(spark.createDataFrame(rows, "k bigint, node bigint, root bigint")).collect():
        cells.setdefault((r.k, r.i, r.j), []).append(r)
    met = {
        (a.node, b.node) for (_, i, j), own in cells.items() for a in own for b in own
        if a.node < b.node and a.root != b.root and (i == j or a.side != b.side)
    }
    want = {(a, b) for k, a, x in rows for l, b, y in rows if k == l and a < b and x != y}
    assert met == want and not any(k == 4 for k, *_ in cells)
    assert all(len(own) <= 8 * side for own in cells.values())


def test_linked_fingerprints_share_a_bucket(spark):
    rows = [(1, [0]), (2, [3]), (3, [15]), (4, [2**40 - 1]), (5, [2**40 - 1, 1023 << 50]), (6, [-1])]
    found = near_copies.print_buckets(spark.createDataFrame(rows, "node bigint, prints array<bigint>")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.k, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]]


def test_fingerprints_alone_find_copies_and_the_check_decides(spark, monkeypatch):
    """Without a min-hash bucket, one changed word of many is found; texts alike in their repeated part only stay."""
    monkeypatch.setattr(near_copies, "buckets", lambda nodes: nodes.select("node", "node").toDF("k", "node").limit(0))
    more = LONG + " " + " ".join(f"own{i}" for i in range(300))
    rows = [(1, LONG), (2, LONG.replace(" w5 ", " other ", 1)), (3, more), (4, "something else " * 9)]
    assert {r.doc_id for r in keep_one(documents(spark, rows)).collect()} == {1, 3, 4}
    prints = [near_copies.fingerprint(t.encode()) for t in (LONG, more)]
    assert 2 >= (prints[0] ^ prints[1]).bit_count()
