"""Line de-duplication against brute force."""

import random

import pytest

from shelfmatch.llm.line_dedup import deduplicated, within
from tests.llm.helpers import LONG, documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def changed(draw, text, times, letters="xyé"):
    out = list(text)
    for _ in range(times):
        at = draw.randint(0, len(out))
        out[at : at + draw.choice([0, 1])] = [draw.choice(letters)] * draw.choice([0, 1])
    return "".join(out)


def test_banded_distance():
    draw = random.Random(2)
    for _ in range(3000):
        a = "".join(draw.choice("abc") for _ in range(draw.randint(0, 9)))
        b = changed(draw, a, draw.randint(0, 4), "abd")
        for most in range(4):
            assert within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def brute(rows, least, most):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    first, links, late, out = {}, {}, set(), {}
    for k, (_, text) in enumerate(rows):
        for at, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= least:
                first.setdefault(line, (k, at))
    lines = list(first)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if distance(a, b) <= most if abs(len(a) - len(b)) <= most and len(a) < 200 else False:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                late.add(b if first[a] < first[b] else a)
    for k, (i, text) in enumerate(rows):
        left, drop, linked = [], 0, 0
        for at, line in enumerate(text.split("\n") if text is not None else []):
            here = first.get(line) == (k, at)
            linked += links.get(line, 0) * here
            if line in first and (not here or line in late):
                drop += 1
            else:
                left.append(line)
        out[i] = ("\n".join(left) if text is not None else None, 0 if text is None else text.count("\n") + 1, drop, linked)
    return out


def corpus(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcde  ") for _ in range(draw.randint(18, 30))) for _ in range(25)]
    rows = [
        (i, "\n".join(changed(draw, draw.choice(base), draw.choice([0, 0, 1, 1, 2, 3])) for _ in range(draw.randint(0, 5)))) for i in range(60)
    ]
    return [*rows, (None, rows[3][1]), (100, None), (101, ""), (102, "\n\n"), (103, LONG), (104, "short\n" + LONG)]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_lines_like_brute_force(spark, most):
    rows = corpus(most)
    df = documents(spark, rows)
    found = deduplicated(df, least_chars=20, most_edits=most)
    assert found.columns == [*df.columns, "n_lines", "n_dropped", "n_links"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.n_links) for r in found.collect()} == brute(rows, 20, most)


def test_repeated_rows_stay_and_empty_table(spark):
    line = "this line is long enough to count"
    rows = deduplicated(documents(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, line), (1, line), (2, "")]
    assert deduplicated(documents(spark, [])).count() == 0


def test_short_repeats_are_dropped_exactly(spark):
    long = "this line is long enough to be compared by edits"
    rows = [(1, f"Menu\n\n{long}\nmenu"), (2, f"\n Menu\nMenu\n{long}!\nmenus\n  \nMenu"), (3, "menu"), (4, None), (None, "Menu\nnew")]
    found = {r.doc_id: (r.text, r.n_dropped) for r in deduplicated(documents(spark, rows), short_repeats=True).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("\n Menu\nmenus\n  ", 3), 3: ("", 1), 4: (None, 0), None: ("new", 1)}
