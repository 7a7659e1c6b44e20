"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import re
from functools import lru_cache
from zlib import crc32

import pytest

from shelfmatch.llm import turn_repair
from shelfmatch.llm.turn_repair import conversation_digests, op11_turn_repair, repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, __conv string, copies int"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = text.rstrip(" \t\n\x0b\x0c\r")
        blank = not words
        out.append("blank" if blank else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """The contract for one conversation: a table of all states, relaxed until nothing gets lighter."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = faults_of(rows)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4 * 4):
            for p, (cost, audit, kept) in list(best.items()):
                for role in ("user", "assistant"):
                    if (q := step.get((p, role[0]))) is not None:
                        best[q] = min(best.get(q, (10**9,)), (cost + 3, audit + "I", (*kept, f"{role}:")))
        if i == len(rows):
            break
        after = {}
        role, text = rows[i][2:]
        for p, (cost, audit, kept) in best.items():
            found = [(p, cost + 4, audit + "D", kept)]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                edits = [(role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")]
                found += [(step[p, r[:1]], cost + c + more, audit + e, (*kept, f"{r}:{text}")) for r, c, e in edits if (p, r[:1]) in step]
            for q, *value in found:
                after[q] = min(after.get(q, (10**9,)), tuple(value))
        best = after
    cost, audit, kept = min(best[q] for q in (0, 3) if q in best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert GOOD.match("".join(k[:1] for k in kept))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def expected(rows, damage=True):
    after = hurt(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    convs = {r[0] for r in rows}
    return sorted(((c, *plain([r for r in after if r[0] == c])) for c in convs), key=str)


def some_rows(seed, convs, most):
    draw = random.Random(seed)
    texts = ["Hello.", "What?", "no end", "", " \n", None, "Yes! ", "a. b", "Long one.\t", "x"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "support"]
    return [
        (c, draw.choice([t, t, t, t * 3, None]), draw.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], draw.choice(texts))
        for c in range(convs) for t in range(draw.randint(1, most))
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_every_small_repair_is_the_cheapest():
    """All sequences of edits, with up to three insertions at a place, for short conversations."""
    draw = random.Random(8)
    for _ in range(150):
        rows = [{"initial": draw.choice("suax"), "fault": draw.choice(["", "", "blank", "duplicate", "truncated"]), "copies": draw.choice([1, 1, 2])}
                for _ in range(draw.randint(1, 4))]

        @lru_cache(None)
        def all_edits(i, roles):
            if i == 2 * len(rows) + 1:
                return [(0, "")] if GOOD.match(roles) else []
            if i % 2 == 0:
                return [(3 * len(x) + c, "I" * len(x) + a) for x in ("", "u", "a", "ua", "au", "uau", "aua") for c, a in all_edits(i + 1, roles + x)]
            row = rows[i // 2]
            n, out = row["copies"] - 1, []
            out += [(4 * n + 4 + c, "D" * (n + 1) + a) for c, a in all_edits(i + 1, roles)]
            if row["fault"] in ("", "truncated"):
                more = 4 * n + 3 * (row["fault"] == "truncated")
                for x, c0, e in ((row["initial"], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    out += [(c0 + more + c, e + "D" * n + a) for c, a in all_edits(i + 1, roles + x)]
            return out

        best = turn_repair.block_spans(rows, True, True)["spans"][0]
        assert (best["cost"], best["audit"]) == min(all_edits(0, ""))


@pytest.mark.parametrize("block, fan_in", [(64, 16), (3, 2), (1, 3)])
def test_repairs_match_the_plain_search(spark, tmp_path, monkeypatch, block, fan_in):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "FAN_IN", fan_in)
    rows = some_rows(block, 60, 14) + [(1000, t, "user", "Same words.") for t in range(90)] + [(None, 1, "user", "Nobody."), (None, None, "assistant", "Here.")]
    rows += [(1001, 5, "assistant", "Again.")] * 70 + [(1002, t, ["user", "assistant", "user"][t % 3], f"{t}.") for t in range(80)]
    random.Random(1).shuffle(rows)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_turn_repair(spark, str(tmp_path)).collect()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == expected(rows)


def test_turns_of_a_repair(spark):
    rows = [(1, 0, "assistant", "First."), (1, 1, "user", "Second"), (1, 1, "user", "Second"), (1, 2, "tool", "Third.")]
    done = repair(frame(spark, rows))
    turns = [(r.place, r.edit, r.turn, r.role, r.text, r.copies) for r in done.turns.orderBy("seq", "place").collect()]
    summary = done.summaries.first()
    assert summary.audit == "IKKDR" and summary.cost == 13 and summary.gaps == 0
    assert turns == [
        (-1, "I", None, "user", "", 1), (0, "K", 0, "assistant", "First.", 1), (0, "K", 1, "user", "Second", 2), (0, "R", 2, "assistant", "Third.", 1)]
    one = repair(frame(spark, [(3, 4, "user", "A."), (3, 5, "user", "B?"), (3, 6, "assistant", " \t")]))
    turns = [(r.place, r.edit, r.role, r.text) for r in one.turns.orderBy("seq", "place").collect()]
    assert turns == [(0, "K", "user", "A."), (0, "R", "assistant", "B?"), (0, "D", "assistant", " \t")]
    want = hashlib.sha256(b"user:A.\nassistant:B?").hexdigest()
    assert [tuple(r) for r in conversation_digests(one.turns).collect()] == [(3, want)]


def test_no_rows(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_turn_repair(spark, str(tmp_path)).count() == 0
    assert repair(frame(spark, [])).turns.count() == 0


def test_query_reads_every_conversation(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = op11_turn_repair(spark, sf).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
