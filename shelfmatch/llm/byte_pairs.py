"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 4)."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import table

#: Characters of a text, and bytes of one match, up to which a leaf is encoded at once.
TEXT_LEAF, MATCH_LEAF = 16_384, 24
#: Known matches kept by a worker; when full, it starts anew.
CACHE = 200_000
#: Characters of text after which a batch of results is handed over.
BATCH_CHARS = 1_000_000


class _Known(dict):
    """Identifiers of matches, worked out once; a bounded number of short ones are kept."""

    def __init__(self, ids_of: Callable[[str], bytes]) -> None:
        self.ids_of = ids_of

    def __missing__(self, match: str) -> bytes:
        found = self.ids_of(match)
        if len(match) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[match] = found
        return found


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split_leaf = regex.compile(pattern).findall
        self.known = _Known(self.ids_of)

    # Splitting: a node of the tree is the list of matches of its span of text.

    def split(self, text: str) -> list[str]:
        if len(text) <= TEXT_LEAF:
            return self.split_leaf(text)
        middle = len(text) // 2
        return self.join_matches(self.split(text[:middle]), self.split(text[middle:]))

    @staticmethod
    def settled(matches: list[str]) -> int:
        """How many first matches stay whatever text follows.

        A match is decided by the text from its start to one character beyond it, or to the third
        character for an apostrophe, which may begin an abbreviated word. So only matches that
        touch the end, and an apostrophe among the last two characters, are open.
        """
        keep, after = len(matches) - 1, len(matches[-1])
        for at in range(len(matches) - 2, -1, -1):
            after += len(matches[at])
            if after > 2:
                break
            if matches[at][0] == "'":
                keep = at
        return max(0, keep)

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of the joined text: split a growing window again until it meets a boundary of
        ``right``. What follows a boundary depends only on the text behind it, so the rest stays."""
        if not left or not right:
            return left or right
        keep, width = self.settled(left), 2
        tail = "".join(left[keep:])
        while True:
            window = self.split_leaf(tail + "".join(right[:width]))
            if width >= len(right):
                return left[:keep] + window
            ends, at = {}, len(tail)
            for i in range(width):
                at += len(right[i])
                ends[at] = i + 1
            at = 0
            for i in range(self.settled(window)):
                at += len(window[i])
                if at in ends:
                    return left[:keep] + window[: i + 1] + right[ends[at]:]
            width *= 2

    # Merging inside one match: a node is the list of tokens of its span of bytes.

    def merge_leaf(self, piece: bytes) -> list[bytes]:
        """Merge the pair with the lowest rank, the first on ties, until no pair has one."""
        rank, none = self.ranks.get, 1 << 62
        ends = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            del pairs[at], ends[at + 1]
            if at:
                pairs[at - 1] = rank(piece[ends[at - 1] : ends[at + 1]], none)
            if at < len(pairs):
                pairs[at] = rank(piece[ends[at] : ends[at + 2]], none)
        return [piece[i:j] for i, j in zip(ends, ends[1:])]

    def merge(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            return [piece]
        if len(piece) <= MATCH_LEAF:
            return self.merge_leaf(piece)
        middle = len(piece) // 2
        return self.join_tokens(self.merge(piece[:middle]), self.merge(piece[middle:]))

    @lru_cache(maxsize=65_536)
    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        return self.merge_leaf(a + b) == [a, b]

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of the joined bytes. A sequence in which every two neighbours are stable is the
        encoding of its bytes; inside both sides they are, so only a window around the seam is
        encoded again, and it grows until both of its edges are stable."""
        if not left or not right:
            return left or right
        a = b = 0
        window: list[bytes] = []
        while True:
            before, after = left[len(left) - a - 1 : len(left) - a], right[b : b + 1]
            edge = (window[:1] or after), (window[-1:] or before)
            left_open = bool(before) and not self.stable(before[0], edge[0][0])
            right_open = bool(after) and not self.stable(edge[1][0], after[0])
            if not left_open and not right_open:
                return left[: len(left) - a] + window + right[b:]
            a = min(len(left), 2 * a + 1) if left_open else a
            b = min(len(right), 2 * b + 1) if right_open else b
            window = self.merge_window(b"".join(left[len(left) - a :] + right[:b]))

    def merge_window(self, piece: bytes) -> list[bytes]:
        """A window is encoded from single bytes; long ones keep their pairs in a heap."""
        if len(piece) <= 4 * MATCH_LEAF:
            return self.merge_leaf(piece)
        size, ranks = len(piece), self.ranks
        end = list(range(1, size + 1))  # of the token that starts here; 0 where none does
        before = list(range(-1, size - 1))
        pairs = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(pairs)
        while pairs:
            _, i, stop = heappop(pairs)
            middle = end[i]
            if not middle or middle >= size or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < size:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(pairs, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heappush(pairs, (rank, left, stop))
        out, i = [], 0
        while i < size:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def ids_of(self, match: str) -> bytes:
        return np.array([self.ranks[t] for t in self.merge(match.encode())], np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Identifiers of the whole text as 32-bit numbers, one after the other."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, np.int32).tolist()))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text and decode the identifiers again: ``doc_id, ids, decoded``.

    Every match of ``pattern`` is encoded by the ranks of the file, without special tokens. Texts
    longer than a leaf are split by halves and joined (``Codec.join_matches``), long matches
    likewise (``Codec.join_tokens``); both give what one pass over the whole text gives. Null counts
    as empty and gives no identifiers; bytes that are not UTF-8 count as the replacement character.
    Identifiers may be null or repeat: rows are independent. Other columns are not read. Each
    executor must see ``ranks_path``. Memory of a task is a batch of texts and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)

        def out(names: pa.Array, found: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            return pa.RecordBatch.from_arrays(
                [names, ids, pa.array(map(coder.decode, found), pa.binary())], names=["doc_id", "ids", "decoded"]
            )

        for batch in batches:
            first, chars, found = 0, 0, []
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or b"").decode("utf-8", "replace")
                found.append(coder.encode(text))
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield out(batch.column(0).slice(first, len(found)), found)
                    first, chars, found = i + 1, 0, []
            if found:
                yield out(batch.column(0).slice(first, len(found)), found)

    schema = T.StructType([
        T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType()),
    ])
    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_ranks() -> tuple[str, str]:
    """Path of the 50k rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), *public_ranks()))
