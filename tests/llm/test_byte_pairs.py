"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfmatch.llm import byte_pairs
from shelfmatch.llm.byte_pairs import Codec, encode_documents, public_ranks
from tests.llm.helpers import AWKWARD, documents


@pytest.fixture(scope="module")
def library():
    path, pattern = public_ranks()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 9, 1000])
def test_trees_of_any_leaf(library, monkeypatch, leaf):
    monkeypatch.setattr(byte_pairs, "TEXT_LEAF", leaf)
    monkeypatch.setattr(byte_pairs, "MATCH_LEAF", leaf)
    coder, draw = Codec(*public_ranks()), random.Random(leaf)
    for _ in range(1500):
        letters = draw.choice(["ab", "aA '", "'sretvlmd x", "  \n\tb", "aé漢😀 1", "the ing and", "0123 .,;-", "aaaa"])
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        ids = coder.encode(text)
        assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 20_000, " " * 30_000, "漢字" * 3_000, "x'r" * 9_000 + "e"])
def test_long_matches(library, text):
    assert np.frombuffer(Codec(*public_ranks()).encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_documents(spark, library):
    found = encode_documents(documents(spark, AWKWARD), *public_ranks()).collect()
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in found)
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in AWKWARD)
    assert encode_documents(documents(spark, []), *public_ranks()).count() == 0


def test_other_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = encode_documents(documents(spark, AWKWARD), path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in AWKWARD)
