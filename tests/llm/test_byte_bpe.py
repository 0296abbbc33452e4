"""Byte-level BPE against the other library that reads the same ranks."""

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barwright.llm import byte_bpe as B

FILE = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "   a", "a   ", "a \n\n b", "   b", "x　 y  z", "\x1c\x1d a\x85b", "don't DON'T 'S's", "1234567 12.5%", "日本語テキスト", "👩‍👩‍👧‍👦 é é", "a" * 3000, " " * 3000, "\t" * 50 + "x", "!!!???--- ...", "naïve café Straße", "ab" * 500 + " aaaa aaa aa a", "\u0000�\U0010ffff"]


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(FILE, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(FILE), special_tokens={})


def test_odd_texts_equal_the_library(vocabulary, library):
    ids, starts, bounds = B.Encoder(vocabulary).encode([t or "" for t in ODD])
    for t, i, j in zip(ODD, bounds, bounds[1:], strict=False):
        want, places = library.decode_with_offsets(library.encode_ordinary(t or ""))[0], library.decode_with_offsets(library.encode_ordinary(t or ""))[1]
        assert want == (t or "")
        assert ids[i:j].tolist() == library.encode_ordinary(t or "")
        assert starts[i:j].tolist() == places
        whole, ends = B.decode_ids(vocabulary, ids[i:j].astype("int64"))
        assert whole == (t or "").encode()
        assert not t or ends[-1] == len(t)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t 　ab'st1!é日👩"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_equals_the_library(vocabulary, library, text):
    ids, starts, _ = B.Encoder(vocabulary).encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert B.decode_ids(vocabulary, ids.astype("int64"))[0].decode() == text


def test_every_character_equals_the_library(vocabulary, library):
    encoder = B.Encoder(vocabulary)
    texts = [f"a{chr(c)}1 {chr(c)} b" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, _, bounds = encoder.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]


def test_tokens_that_end_inside_a_character(vocabulary):
    table = B.Encoder(vocabulary)
    text = "x𓂀y"
    ids, starts, _ = table.encode([text])
    whole, ends = B.decode_ids(vocabulary, ids.astype("int64"))
    assert len(ids) > 3 and ends[-1] == 3 and sorted(ends) == list(ends) and 1 in ends[1:-1]
    assert B.decode_ids(vocabulary, ids[1:3].astype("int64"))[1].tolist()[-1] >= 1  # bytes of no character count one by one


def test_an_encoder_that_forgets(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_PARTS", 3)
    encoder = B.Encoder(vocabulary)
    for t in ("one two three", "two four five", "one six", ""):
        assert encoder.encode([t])[0].tolist() == library.encode_ordinary(t)
    assert len(encoder.number) <= 8


def test_rows_of_a_table(spark, library):
    rows = [(i, t, "kept", "mine") for i, t in enumerate(ODD)] + [(0, "again", None, None)] * 2 + [(99, "long words " * 50_000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `text to encode` string, Ids string")
    got = B.encode(docs, FILE, P.PATTERN, packed="packed")
    assert got.columns == ["doc_id", "text", "text to encode", "ids", "starts", "packed"]
    back = B.decode(got, FILE, P.PATTERN, text="again", ends="ends").collect()
    assert len(back) == len(rows)
    for r in back:
        t = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(t)
        assert bytes(r["packed"]) == b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert bytes(r["decoded"]).decode() == t == r["again"]
        assert len(r["ends"]) == len(r["starts"]) == len(r["ids"])
    assert B.encode(docs.limit(0), FILE, P.PATTERN).count() == 0


def test_ids_that_are_null_or_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in B.decode(rows, FILE, P.PATTERN).orderBy("k").collect()] == [None, b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        B.decode(spark.createDataFrame([([50256],)], "ids array<int>"), FILE, P.PATTERN).collect()


def test_tokens_that_merges_never_make():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"acb": 6}
    assert B.last_merge(b"abc", ranks) == (b"a", b"bc")
    assert B.last_merge(b"acb", ranks) is None
