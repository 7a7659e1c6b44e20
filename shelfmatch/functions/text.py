"""Column functions over recognised label text.

Everything is a JVM expression, except Unicode compatibility forms: only values holding a
character outside the plain Latin and Cyrillic letters go through an Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch import constants as K

# Letters for which lower-casing plus "ß" -> "ss" is full case folding and NFKC changes nothing.
PLAIN_TEXT = r"\A[\x00-\x7FÀ-ÖØ-öø-ÿА-Яа-яЁё]*\z"
# Runs other than one plain space, so that single spaces are not rewritten.
PLAIN_SPACE_RUN = r" [\x09-\x0D\x1c-\x1f ]+|[\x09-\x0D\x1c-\x1f][\x09-\x0D\x1c-\x1f ]*"
SPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _fold_plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _unless_plain(c: Column, plain: Column, udf: Callable[[Column], Column]) -> Column:
    """``plain`` where it is exact; only other values are sent to Python, the rest as NULL.

    The test is evaluated once per value: equal character and byte counts prove ASCII without it.
    """
    is_plain = (F.length(c) == F.octet_length(c)) | c.rlike(PLAIN_TEXT)
    return F.coalesce(udf(F.when(~is_plain, c)), plain)


@F.pandas_udf(T.StringType())
def _nfkc_casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(
            lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split()), na_action="ignore"
        )


@F.pandas_udf(T.StringType())
def _casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: s.casefold(), na_action="ignore")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def casefold(c: Column) -> Column:
    return _unless_plain(c, _fold_plain(c), _casefold)


def normalize_text(c: Column) -> Column:
    """NFKC, case folding, single spaces, trimmed."""
    return _unless_plain(c, F.trim(F.regexp_replace(_fold_plain(c), PLAIN_SPACE_RUN, " ")), _nfkc_casefold)


def clean_value(c: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.regexp_replace(c, rf"\A{SPACE_RUN}|{SPACE_RUN}\z", ""), F.lit(""))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.TOKEN_PATTERN), F.lit(0))


def extract_years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.YEAR_PATTERN), F.lit(0))


def extract_percentages(c: Column) -> Column:
    """Structs (value, normalized_value): spaces before the sign are dropped, comma is a point."""
    found = F.regexp_extract_all(c, F.lit(K.PERCENT_PATTERN), F.lit(0))
    return F.transform(found, lambda m: F.struct(
        F.regexp_replace(m, SPACE_RUN, "").alias("value"),
        F.replace(F.regexp_replace(m, SPACE_RUN, ""), F.lit(","), F.lit(".")).alias("normalized_value"),
    ))


def extract_volumes(c: Column) -> Column:
    """Structs (value, normalized_value) with the unit written as ml, l or cl."""
    def parts(m: Column) -> Column:
        number = F.regexp_extract(m, r"\A[\p{Nd}.,]+", 0)
        unit = F.regexp_extract(m, r"\p{L}+\z", 0)
        folded = F.lower(unit)
        normal = (
            F.when(folded.isin("мл", "ml"), "ml").when(folded.isin("л", "l"), "l")
            .when(folded.isin("cl", "сl"), "cl").otherwise(folded)
        )
        return F.struct(
            F.concat_ws(" ", number, unit).alias("value"),
            F.concat_ws(" ", F.replace(number, F.lit(","), F.lit(".")), normal).alias("normalized_value"),
        )

    return F.transform(F.regexp_extract_all(c, F.lit(K.VOLUME_PATTERN), F.lit(0)), parts)


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def word_set(c: Column) -> Column:
    """Distinct words of three or more letters."""
    folded = F.replace(casefold(c), F.lit("ё"), F.lit("е"))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(K.WORD_PATTERN), F.lit(0)))


def informative_words(c: Column) -> Column:
    return F.array_except(word_set(c), F.array(*[F.lit(w) for w in K.GENERIC_WORDS]))


def letters_in(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))


def repair_lookalikes(c: Column) -> Column:
    """Words made only of Cyrillic letters and look-alikes are rewritten in Cyrillic."""
    letters = K.LOOKALIKE_FROM + K.LOOKALIKE_FROM.upper()
    similar = rf"^(?!\p{{Nd}}+$)[а-яёА-ЯЁ{letters}]{{3,}}$"
    pieces = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    repaired = F.transform(pieces, lambda p: (
        F.when(p.rlike(similar), F.translate(F.lower(p), K.LOOKALIKE_FROM, K.LOOKALIKE_TO))
        .when(p.rlike(r"^[\p{L}\p{N}_]"), _fold_plain(p)).otherwise(p)
    ))
    return F.array_join(repaired, "")


def embedding_query_text(text: Column, name: Column) -> Column:
    """The repaired name once in front of the repaired full text."""
    title = F.nullif(F.trim(repair_lookalikes(F.coalesce(name, F.lit("")))), F.lit(""))
    return F.concat_ws(" ", title, repair_lookalikes(text))


def passage_text(columns: dict[str, Column]) -> Column:
    """Labelled attributes in fixed order, blanks skipped."""
    lines = []
    for field, label in K.PASSAGE_LABELS.items():
        value = clean_value(columns[field])
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value)))
    return F.concat_ws("\n", *lines)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*\z", 0)


def file_suffix(c: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(base_name(c), r"(?<=[^/])\.[^./]+\z", 0))


def file_stem(c: Column) -> Column:
    name = base_name(c)
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+\z", "")


def photo_key(c: Column) -> Column:
    """Spelling-independent key of a photo file name."""
    key = F.regexp_replace(F.regexp_replace(file_stem(c), K.VARIANT_PREFIX, ""), K.STORAGE_HASH, "")
    key = _fold_plain(key)
    for letter, latin in K.TRANSLIT_MANY.items():
        key = F.replace(key, F.lit(letter), F.lit(latin))
    key = F.translate(key, K.TRANSLIT_ONE_FROM + K.TRANSLIT_DROPPED, K.TRANSLIT_ONE_TO)
    return F.regexp_replace(key, "[^a-z0-9]+", "")


def _name_pattern() -> str:
    """Matches a normalized text with three letters that is no generic line, prefix or phrase."""
    quoted = lambda words: "|".join(f"\\Q{w}\\E" for w in words)
    return (
        rf"(?s)\A(?!(?:{quoted(K.GENERIC_LINES)})\z|{quoted(K.REGULATORY_PREFIXES)})"
        rf"(?!.*(?:{quoted(K.GENERIC_PHRASES)}))(?:[^\p{{L}}]*+\p{{L}}){{3}}"
    )


def clean_name(c: Column) -> Column:
    """Name-like text without years and edge punctuation; empty when it cannot be a name."""
    undated = F.when(c.rlike("19|20"), F.regexp_replace(c, K.YEAR_PATTERN, "")).otherwise(c)
    cleaned = F.trim(undated, F.lit(K.NAME_EDGE_CHARACTERS))
    usable = (F.length(cleaned) <= 60) & normalize_text(cleaned).rlike(_name_pattern())
    return F.when(usable, cleaned).otherwise(F.when(c.isNotNull(), ""))


def contains_phrase(text: Column, phrase: Column, normalized: bool = False) -> Column:
    """Whole, contiguous phrase after normalization, whatever characters the phrase holds."""
    haystack = text if normalized else normalize_text(text)
    needle = phrase if normalized else normalize_text(phrase)
    word = r"[\p{L}\p{N}_]"
    quoted = F.concat(
        F.lit(f"(?<!{word})\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit(f"\\E(?!{word})"),
    )
    # The plain search is far cheaper than a per-row pattern and discards most rows.
    return F.coalesce((needle != "") & haystack.contains(needle) & F.rlike(haystack, quoted), F.lit(False))


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def character_error_rate(truth: Column, prediction: Column) -> Column:
    t, p = normalize_text(truth), normalize_text(prediction)
    return (
        F.when((t == "") & (p == ""), F.lit(0.0)).when(t == "", F.lit(1.0))
        .otherwise(F.levenshtein(t, p) / F.length(t))
    )


def exact_fields(truth: dict[str, Column], prediction: dict[str, Column]) -> Column:
    """Struct of booleans name, producer, year and all."""
    same = {
        f: normalize_text(truth[f]) == normalize_text(prediction[f])
        for f in ("name", "producer", "year")
    }
    return F.struct(
        *[c.alias(f) for f, c in same.items()],
        (same["name"] & same["producer"] & same["year"]).alias("all"),
    )


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def chunk_words(c: Column, max_tokens: int) -> Column:
    """Chunks of at most ``max_tokens`` whitespace words; a text within the budget stays whole."""
    def chunks(words: Column) -> Column:
        count = F.size(words)
        numbers = F.sequence(F.lit(0), F.floor((count - 1) / max_tokens).cast("int"))
        return (
            F.when(count == 0, F.array().cast("array<string>")).when(count <= max_tokens, F.array(c))
            .otherwise(F.transform(
                numbers, lambda i: F.array_join(F.slice(words, i * max_tokens + 1, F.lit(max_tokens)), " ")))
        )

    # Split once per text: the words are bound as the element of a one-element array.
    return F.transform(F.array(words_of(c)), chunks)[0]


def chunk_by_tokens(max_tokens: int, count_tokens: Callable[[str], int]) -> Callable[[Column], Column]:
    """Chunker for a model tokenizer; returns struct (chunks, error) so that one bad row fails alone.

    ``count_tokens`` counts the whole candidate chunk, since token counts do not add up over words.
    """
    @F.pandas_udf("struct<chunks:array<string>,error:string>")
    def chunker(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_chunk_one(text, max_tokens, count_tokens) for text in batch]
            yield pd.DataFrame(rows, columns=["chunks", "error"])

    return chunker


def _chunk_one(text, max_tokens, count_tokens):
    words = (text or "").split()
    if not words:
        return [], None
    if count_tokens(text) <= max_tokens:
        return [text], None
    if any(count_tokens(w) > max_tokens for w in words):
        return None, "One word exceeds the token limit"
    chunks, begin = [], 0
    for end in range(1, len(words) + 1):
        if count_tokens(" ".join(words[begin:end])) > max_tokens:
            chunks.append(" ".join(words[begin:end - 1]))
            begin = end - 1
    chunks.append(" ".join(words[begin:]))
    return chunks, None


def normalize_slug(c: Column, card_url: str) -> Column:
    """Struct (slug, valid): a slug, or a card URL reduced to its last path segment."""
    value = clean_value(c)
    prefix = card_url.rstrip("/") + "/"
    path = F.regexp_replace(F.substr(value, F.lit(len(prefix) + 1)), "/+$", "")
    slug = F.when(value.contains("://"), F.when(value.startswith(prefix), path)).otherwise(value)
    valid = value.isNull() | F.coalesce(slug.rlike(K.SLUG_PATTERN), F.lit(False))
    return F.struct(F.when(valid, slug).alias("slug"), valid.alias("valid"))
