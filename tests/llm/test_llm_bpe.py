"""Byte-level BPE against tiktoken, round trips, appends and edits."""

import base64
import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weaklabel.llm.bpe import PrefixTable, Vocabulary, decode, encode, encode_decode, encode_piece

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


def test_whole_table(spark, tiny, theirs):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_decode(docs, PATH, public.PATTERN, ["doc_id"]).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(theirs, text):
    (ids,) = encode([text], PATH, public.PATTERN)
    assert ids == theirs.encode_ordinary(text)
    assert decode(ids, PATH, public.PATTERN) == text.encode()


def test_pieces_that_merge_much(vocabulary, theirs):
    draw = random.Random(3)
    for _ in range(3000):
        piece = "".join(draw.choice("aeinorst") for _ in range(draw.randint(1, 24)))
        assert encode_piece(vocabulary, piece.encode()) == theirs.encode_ordinary(piece)
    for piece in ("a" * 5000, "ab" * 2000, "=" * 3000):
        assert encode_piece(vocabulary, piece.encode()) == theirs.encode_ordinary(piece)


@settings(max_examples=150, deadline=None)
@given(st.text("abestinrou", max_size=60), st.text("abestinrou", max_size=20), st.data())
def test_appends_and_edits_are_exact(vocabulary, text, new, data):
    whole = text.encode()
    table = PrefixTable(vocabulary, whole[: len(whole) // 2])
    table.append(whole[len(whole) // 2 :])
    assert table.tokens() == encode_piece(vocabulary, whole) if whole else table.tokens() == []
    a = data.draw(st.integers(0, len(whole)))
    b = data.draw(st.integers(a, len(whole)))
    table.replace(a, b, new.encode())
    edited = whole[:a] + new.encode() + whole[b:]
    assert bytes(table.data) == edited
    assert table.tokens() == (encode_piece(vocabulary, edited) if edited else [])
    assert table.last == PrefixTable(vocabulary, edited).last


def test_an_edit_works_out_few_entries(vocabulary):
    draw = random.Random(5)
    text = "".join(draw.choice("aeinorst") for _ in range(4000)).encode()
    table = PrefixTable(vocabulary, text)
    assert table.replace(100, 103, b"xyz") < 1000
    assert table.last == PrefixTable(vocabulary, text[:100] + b"xyz" + text[103:]).last


def test_defined_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "hello hello", 7)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), PATH, public.PATTERN, ["doc_id"], with_ids=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in got if r.doc_id is not None] == [(0, nothing)] * 3
    assert [bytes(r.decoded) for r in got if r.doc_id is None] == [b"hello hello"]
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, public.PATTERN, ["doc_id"]).count() == 0


def test_a_token_is_its_own_encoding_without_pair_checks():
    fresh = Vocabulary.read(PATH)
    for token in (b" the", b"ation", b" because"):
        assert encode_piece(fresh, token) == [fresh.rank[token]]
    assert not fresh._fits
