"""Encoding and counting against the libraries, and edits of a prefix table against encoding anew."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from odd_rows import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalite.llm import bpe, queries, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _codec_row(library, key, text):
    ids = library.encode_ordinary(text or "")
    return key, len(ids), _sha(" ".join(map(str, ids)).encode()), _sha((text or "").encode())


def test_op1_is_the_library(spark, sf, texts, library):
    got = {tuple(r) for r in queries.op1_bpe_codec(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {_codec_row(library, k, t) for k, t in texts.items()}


def test_op1_odd_rows(odd, none, library):
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted((tuple(r) for r in bpe.digests(odd, RANKS, P.PATTERN).collect()), key=key)
    assert got == sorted((_codec_row(library, k, t) for k, t, *_ in ODD), key=key)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_encode_gives_ids_and_text(odd, library):
    for r in bpe.encode(odd, RANKS, P.PATTERN).collect():
        assert [int(i) for i in r.ids.split()] == library.encode_ordinary(r.decoded.decode())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, vocabulary, text):
    pieces, _ = bpe.text_encoder(RANKS, P.PATTERN)
    assert pieces([text])[0] == " ".join(map(str, library.encode_ordinary(text)))


def test_edits_and_appends(library, vocabulary):
    draw = random.Random(4)
    table = bpe.PrefixTable(vocabulary, b"")
    whole = lambda data: bpe.PrefixTable(vocabulary, data).ids()
    for _ in range(60):
        new = "".join(draw.choice("abc theingro ") for _ in range(draw.randrange(12))).encode()
        if draw.random() < 0.4:
            table.append(new)
        else:
            start = draw.randrange(len(table.data) + 1)
            table.replace(start, draw.randrange(start, len(table.data) + 1), new)
        assert table.ids() == whole(table.data)
        end = draw.randrange(len(table.data) + 1)
        assert table.ids(end) == whole(table.data[:end])


def test_prefix_table_is_merging_by_rank(library, vocabulary):
    for data in (b"internationalization", b"a" * 3000, "日本語日本語".encode(), b"\x00\xff\xfe", b"thethethethe"):
        assert bpe.PrefixTable(vocabulary, data).ids() == library._encode_single_piece(data)


def test_op6_is_the_library(spark, sf, texts, counter):
    got = {tuple(r) for r in queries.op6_token_counts(spark, sf).collect()}
    n = {k: len(counter.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert got == {(k, len(t.encode()), n[k], n[k] > 1024) for k, t in texts.items()}


def test_op6_odd_rows(odd, none, counter):
    count = lambda df: token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN, 1024)
    key = lambda r: (str(r[0]), *r[1:])
    n = [len(counter.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD]
    assert sorted((tuple(r) for r in count(odd).collect()), key=key) == sorted(((k, len((t or "").encode()), m, m > 1024) for (k, t, *_), m in zip(ODD, n, strict=True)), key=key)
    assert count(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_count(counter, text):
    merges, pieces = token_counts.token_counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    if not any(s in text for s in merges.special):
        assert pieces([text])[0] == len(counter.encode(text, add_special_tokens=False).ids)


def test_long_merges_agree(counter):
    merges, _ = token_counts.token_counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for data in (b"a" * 999, b"abcabc" * 50, b"international" * 9):
        assert merges._merged_long(data) == len(counter.encode(data.decode(), add_special_tokens=False).ids)
