"""Small inputs with the awkward cases every operator has to meet."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Clashing names: an extra column that operators use inside or add themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, __id string"


def documents(spark, pairs):
    """A documents table with extra columns from (doc_id, text)."""
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), "x", None) for i, t in pairs], SCHEMA)


LONG = " ".join(f"w{i % 997}" for i in range(60_000))
AWKWARD = [
    (1, "one two  three"), (2, "one two three"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, "one two three"), (7, "one two three"),
    (None, "one two three"), (None, "only here without a name"), (None, None), (8, LONG), (9, "é漢😀 \x0b x"),
]
