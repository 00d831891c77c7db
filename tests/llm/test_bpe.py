"""BPE against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import entry
from paperloom.llm.bpe import BytePairs, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", "  a  b \n\n c", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "\x1c\x1d a\x85b c d​é", "日本語テキスト 漢字👩‍👩‍👧 ñandú",
    "'s 'S don't I'll", "*" * 5000, "ab" * 3000, "\t\t\n a", "x" * 65, "１２３ ⅷ", "áe", "é" * 40, "z" * 100_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH)


def ids_of(pairs, texts):
    return [memoryview(x).cast("i").tolist() for x in pairs.encode_batch(texts)]


def test_odd_texts(library, pairs):
    assert ids_of(pairs, ODD) == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("the ing'\n ")), max_size=120))
def test_any_text_round_trips_as_in_the_library(library, pairs, text):
    (ids,) = ids_of(pairs, [text])
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert pairs.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_long_and_short_trees_agree(pairs):
    words = ["hello", " thermodynamics", "aaaaaaaaaaaaaaaaaaaaaaaa", "ñandúñandú", "=" * 33]
    made = pairs.encode_words(words)
    assert all(memoryview(made[w]).cast("i").tolist() == pairs.encode_long(w.encode()) for w in words)


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 6, None), (None, "c", 7, "y")]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in got) == [(0, "c", 1), (1, "a b", 2), (1, "a b", 2), (2, "", 0)]
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in entry.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))
