import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafclock.llm import bpe
from leafclock.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(RANKS, "rb").read(), PATTERN)


@given(st.text(max_size=60) | st.text("ab é ñ­　\n'sßĀ😀́", max_size=200))
@settings(max_examples=400, deadline=None)
def test_same_ids_and_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    assert "".join(codec.token_texts(ids.tolist())) == text
    spans = codec.offsets(text, ids)
    if len(ids):
        assert spans[0, 0] == 0 and spans[-1, 1] == len(text)
        assert (spans[1:, 0] <= spans[:-1, 1]).all() and (spans[:, 0] < spans[:, 1]).all()


def test_byte_characters_are_one_to_one():
    assert len(set(bpe.byte_characters())) == 256


def test_rows_of_any_kind(spark, reference):
    texts = [None, "", "a", "x" * 50_000, "Ünï 😀 " * 4_000, "same", "same", "\u0000 \t\r\n  end "]
    docs = spark.createDataFrame([(i if i else None, t, "z", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, n_tokens int")
    got = {(r.doc_id): r for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        r = got[i if i else None]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0


def test_split_character_has_shared_offsets(spark, codec):
    text = "x\U0001F9FFy"
    ids = codec.encode(text)
    spans = codec.offsets(text, ids).tolist()
    assert len(ids) > len(text) and sum(s == [1, 2] for s in spans) > 1
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, PATTERN, True).first()
    assert [list(x) for x in zip(row.starts, row.ends)] == spans


def test_unknown_and_null_ids(spark, codec):
    with pytest.raises(ValueError):
        codec.decode(__import__("numpy").array([10**6]))
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, RANKS).collect()] == [b"", b""]
