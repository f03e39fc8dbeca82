"""Packing and token files against plain tokenizing, edge cases, exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.inputs import MESSY, SMALL, messy, no_rows, rows_of, texts_of
from voxgrain.llm import packing, queries, token_files
from voxgrain.llm.common import scratch
from voxgrain.llm.tokens import Encoder

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aA é'sre19.,!\n\t \x1c\xa0́<|>😀", max_size=40))
def test_pieces_give_the_whole_text(path, text):
    ids = np.frombuffer(Encoder(path).encode([text])[0], "<u4").tolist()
    assert ids == plain(path)(text)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_special_tokens_are_what_the_tokenizer_takes_them_for(path):
    texts = ["plain words", "a <|endoftext|> b", "<|startoftext|><|endoftext|>", "x<|ENDOFTEXT|>y <|endoftext|", "plain words", "end <|endoftext|>"]
    assert [np.frombuffer(found, "<u4").tolist() for found in Encoder(path).encode(texts)] == [plain(path)(t) for t in texts]


def test_packing_query(spark):
    encode, texts = plain(WORDS), texts_of(spark)
    pieces = queries.op1_packing(spark, SMALL).collect()
    lengths = {}
    for p in pieces:
        ids = encode(texts[p["doc_id"]]) + [1]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[p["start"]:p["start"] + p["length"]])
        lengths[p["doc_id"]] = lengths.get(p["doc_id"], 0) + p["length"]
    assert lengths == {k: len(encode(t)) + 1 for k, t in texts.items()}
    gapless(pieces, 2048)


def gapless(pieces, length):
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * length + p["offset"] == at and p["offset"] + p["length"] <= length
        at += p["length"]


def test_packing_edges(spark):
    found = packing.pack(messy(spark), WORDS, length=64).collect()
    gapless(found, 64)
    assert sum(p["length"] for p in found) == sum(len(plain(WORDS)(t)) + 1 for _, t, _ in MESSY)
    assert {p["doc_tokens"] for p in found if p["doc_id"] in (3, 4, 5)} == {1}
    assert rows_of(packing.pack(no_rows(spark), WORDS)) == []


def test_token_file_query(spark):
    encode, texts = plain(BYTES), texts_of(spark)
    found = {r["doc_id"]: r for r in queries.op10_token_files(spark, SMALL).collect()}
    at = 0
    for key in sorted(texts):
        ids = encode(texts[key]) + [0]
        assert (found[key]["start"], found[key]["n_tokens"], found[key]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_file_edges(spark):
    path = scratch(spark, "t")
    token_files.write_tokens(messy(spark), path, BYTES)
    found = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 2, *range(3, 11)]
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found[:-1]]]).tolist()
    assert [r["n_tokens"] for r in found if r["doc_id"] in (3, 4)] == [1, 1]
    empty = scratch(spark, "t")
    token_files.write_tokens(no_rows(spark), empty, BYTES)
    assert rows_of(token_files.read_tokens(spark, empty)) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700), st.integers(1, 300))
def test_simple8b_round_trip(ids, block):
    assert token_files.decode_ids(token_files.encode_ids(np.array(ids, np.uint64), block)).tolist() == ids


def test_simple8b_is_dense():
    assert len(token_files.encode_ids(np.full(24_000, 40_000, np.uint64))) < 24_000 / 3 * 8 + 200
    assert len(token_files.encode_ids(np.zeros(24_000, np.uint64))) < 24_000 / 240 * 8 + 200
