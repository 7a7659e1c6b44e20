"""Piecewise fingerprints against a plain reading of the same rule."""

import hashlib
import random

from shelfmatch.llm import piecewise
from shelfmatch.llm.piecewise import edits, fingerprint, fingerprints, likeness, op13_fingerprints, spliced_likeness, triggers
from tests.llm.helpers import AWKWARD, documents


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_ends(data):
    out = []
    for i in range(len(data)):
        h = sum(data[i - k] * int(piecewise._FACTORS[k]) for k in range(min(7, i + 1))) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        ones = len(f"{h:032b}") - len(f"{h:032b}".rstrip("1"))
        if ones >= 2:
            out.append((i + 1, ones))
    return out


def test_edits_match_the_table():
    draw = random.Random(1)
    for _ in range(400):
        a, b = ("".join(draw.choices("abcd", k=draw.randrange(70))) for _ in range(2))
        assert edits(a, b) == plain_edits(a, b)


def test_triggers_match_one_byte_at_a_time(monkeypatch):
    draw = random.Random(2)
    data = bytes(draw.randrange(256) for _ in range(3000))
    for stride in (5, 7, 64, 1 << 20):
        monkeypatch.setattr(piecewise, "STRIDE", stride)
        for size in (0, 1, 6, 7, 8, 3000):
            ends, levels = triggers(data[:size])
            assert list(zip(ends.tolist(), levels.tolist())) == plain_ends(data[:size])


def test_signatures_are_never_cut():
    draw = random.Random(3)
    for data in (b"", b"a", b"ab" * 50_000, b"\0" * 10_000, " ".join(f"w{draw.randrange(999)}" for _ in range(9000)).encode()):
        level, one, two = fingerprint(data).split(":")
        assert len(one) <= 64 and len(two) <= len(one)
    assert fingerprint(b"") == "2::"


def test_likeness_follows_the_shared_part():
    draw = random.Random(4)
    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(120, 900))]
        text = " ".join(words)
        other = " ".join(f"v{draw.randrange(5000)}" for _ in range(500))
        cut = len(text) * 2 // 3
        own = fingerprint(text.encode())
        assert likeness(own, fingerprint((text[:cut] + other[: len(text) - cut]).encode())) > 0.45
        assert likeness(own, fingerprint(("one more " + text).encode())) > 0.7
        assert likeness(own, fingerprint(other.encode())) < 0.35
        assert likeness(own, own) == 1.0
    assert likeness("2::", "2:A:A") == 0.0 and likeness("2:A:A", "5:A:A") == 0.0


def expected(rows):
    out = []
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        size = len(text) // 3
        edited = text[: len(text) - size] + after[:size]
        a, b, c = (fingerprint(t.encode()) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_whole_order_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices(["é", "wine", "漢字", "old", "😀", "label"], k=draw.randrange(60)))) for i in range(300)]
    rows += [(None, "nameless text of no number"), (301, None), (302, "")]
    draw.shuffle(rows)
    for parts in (1, 13):
        found = spliced_likeness(documents(spark, rows).repartition(parts))
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_awkward_rows(spark):
    found = spliced_likeness(documents(spark, AWKWARD)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(i), len(t or "")) for i, t in AWKWARD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    alone = spliced_likeness(documents(spark, [(5, "alone here")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"alone halo").hexdigest()
    assert spliced_likeness(documents(spark, [])).count() == 0
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints(documents(spark, AWKWARD)).collect()}
    assert {(r.doc_id, r.fingerprint) for r in found} == plain


def test_query_reads_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_fingerprints(spark, sf).collect()), key=str) == expected(rows)
