"""Exact and SimHash de-duplication against brute force."""

import hashlib
import random

import pytest
import xxhash

from shelfmatch.llm.components import connected
from shelfmatch.llm.exact_dedup import exact_duplicates
from shelfmatch.llm.simhash import block_masks, close_pairs, fingerprint, keep_one, near_duplicates
from tests.llm.helpers import AWKWARD, WORDS, documents

import re


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out, seen = [], set()
    for i, t in norm:
        ids = [a for a, b in norm if b == t]
        known = [a for a in ids if a is not None]
        keep = min(known) if known else None
        kept = i == keep and (i, t) not in seen
        seen.add((i, t))
        out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run_exact(df, **options):
    return sorted(map(tuple, exact_duplicates(df, **options).collect()), key=str)


def test_exact_awkward(spark):
    assert run_exact(documents(spark, AWKWARD)) == brute_exact(AWKWARD)


@pytest.mark.parametrize("runs, fan_in", [(1, 2), (5, 2), (9, 8)])
def test_exact_tree_shapes(spark, runs, fan_in):
    draw = random.Random(runs)
    rows = [(i, draw.choice(["a", "b  b", "b b", "c"]) if i % 3 else "hot") for i in range(80)]
    assert run_exact(documents(spark, rows), runs=runs, fan_in=fan_in) == brute_exact(rows)


def test_exact_empty(spark):
    assert run_exact(documents(spark, [])) == []


def brute_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_near(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and roots[i] != roots[j]:
                old, new = roots[j], roots[i]
                roots = [new if r == old else r for r in roots]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def near_rows():
    draw = random.Random(3)
    base = [f"word{draw.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base) if i < 40 else [f"word{draw.randrange(500)}" for _ in range(50)]
        for _ in range(i % 4 if i < 40 else 0):
            words[draw.randrange(len(words))] = "Changed"
        rows.append((100 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows", [AWKWARD, near_rows(), []], ids=["awkward", "copies", "empty"])
def test_near_duplicates(spark, rows):
    assert sorted(map(tuple, near_duplicates(documents(spark, rows)).collect()), key=str) == brute_near(rows)


def test_fingerprint_of_long_text_counts_every_shingle():
    text = " ".join(f"w{i}" for i in range(70_000))
    hashes = [xxhash.xxh64_intdigest(f"w{i} w{i+1} w{i+2}".encode(), 42) for i in range(69_998)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert fingerprint(text.encode()) % (1 << 64) == want


def test_large_buckets_connect_like_pairs(spark, monkeypatch):
    draw = random.Random(5)
    values = {0}
    while len(values) < 120:
        values.add(draw.choice(sorted(values)) ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "__fp bigint")
    direct = {tuple(r) for r in connected(close_pairs(prints)).collect()}
    monkeypatch.setattr("shelfmatch.llm.simhash.DIRECT", 2)
    assert {tuple(r) for r in connected(close_pairs(prints)).collect()} == direct


def test_blocks_share_a_mask():
    draw = random.Random(1)
    for _ in range(200):
        a = draw.getrandbits(64)
        b = a ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64)
        assert any((a ^ b) & m % (1 << 64) == 0 for m in block_masks(2, 4))


def test_keep_one_row_of_each_group(spark):
    df = documents(spark, AWKWARD)
    stay = keep_one(df)
    assert stay.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)
    want = [(1, "one two  three"), (3, None), (6, AWKWARD[5][1]), (9, AWKWARD[-1][1]), (None, "only here without a name")]
    assert found == sorted(want, key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
