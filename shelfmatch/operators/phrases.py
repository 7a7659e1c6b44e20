"""Many phrases looked for in many texts, each text read once for a block of phrases."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of phrases in one automaton, and of texts in one cell.
PHRASE_CHARS, TEXT_CHARS = 2_000_000, 16_000_000


def _in_word(character: str) -> bool:
    return character == "_" or unicodedata.category(character)[0] in "LN"


def whole(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` begins and ends where no word goes on."""
    return not (start and _in_word(text[start - 1])) and not (end < len(text) and _in_word(text[end]))


def _cell(texts: pa.Table, phrases: pa.Table) -> pa.Table:
    """Pairs of text and phrase rows of one cell: one automaton, one pass over each text."""
    import ahocorasick

    pairs: list[tuple[int, int]] = []
    words: dict[str, list[int]] = {}
    for at, phrase in enumerate(phrases.column(1).to_pylist()):
        words.setdefault(phrase, []).append(at)
    if words and texts.num_rows:
        machine = ahocorasick.Automaton()
        for phrase, rows in words.items():
            machine.add_word(phrase, (len(phrase), rows))
        machine.make_automaton()
        for at in range(texts.num_rows):
            text, seen = texts.column(1)[at].as_py(), set()
            for last, (size, rows) in machine.iter(text):
                if rows[0] not in seen and whole(text, last + 1 - size, last + 1):
                    seen.add(rows[0])
                    pairs += [(at, row) for row in rows]
    left, right = (pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))
    return pa.table([texts.column(0).take(left), phrases.column(0).take(right)], names=[texts.column_names[0], phrases.column_names[0]])


def phrases_in_texts(
    texts: DataFrame, phrases: DataFrame, text_id: str = "doc_id", phrase_id: str = "item_id", text: str = "text", phrase: str = "phrase",
    phrase_chars: int = PHRASE_CHARS, text_chars: int = TEXT_CHARS,
) -> DataFrame:
    """``text_id, phrase_id`` of every phrase that a text holds whole, once however often it occurs.

    Both sides are normalised texts. A phrase is whole where no letter, digit or underscore touches its
    ends; it may hold any characters. Null and empty phrases and null texts match nothing.
    Phrases are dealt into blocks by characters, texts likewise; a cell of the two builds one automaton and
    reads each of its texts once. No text is cut into words, so no common word gathers rows, and a cell is
    bounded whatever the number of phrases. Texts are copied once per block of phrases.
    """
    wanted = phrases.where(F.col(phrase) != "").select(F.col(phrase_id), F.col(phrase).alias("__p"))
    given = texts.where(F.col(text).isNotNull()).select(F.col(text_id), F.col(text).alias("__t"))
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.length(c)), F.lit(0))).first()[0]
    p_blocks = 1 + size(wanted, "__p") // phrase_chars
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t_blocks = max(spread, 1 + size(given, "__t") // text_chars)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = given.select("*", F.pmod(F.xxhash64(text_id), F.lit(t_blocks)).alias("__tb"), every(p_blocks).alias("__pb"))
    right = wanted.select("*", F.pmod(F.xxhash64("__p"), F.lit(p_blocks)).alias("__pb"), every(t_blocks).alias("__tb"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return _cell(a.select([text_id, "__t"]), b.select([phrase_id, "__p"]))

    schema = T.StructType([texts.schema[text_id], phrases.schema[phrase_id]])
    return left.groupBy("__tb", "__pb").cogroup(right.groupBy("__tb", "__pb")).applyInArrow(cell, schema)
