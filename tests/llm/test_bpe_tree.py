"""The tree's tokens are the library's, and decoding gives the text's bytes back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm.bpe_tree import TreeBpe, encode_column, round_trip

TREE = TreeBpe(leaf=16, leaf_bytes=8)
TREES = [TreeBpe(leaf=leaf, leaf_bytes=leaf_bytes) for leaf, leaf_bytes in ((1, 1), (5, 3), (64, 16), (4096, 512))]
MIXED = st.text(alphabet=st.sampled_from(list("abethn 's\n\t  é1!_ß中😀\x1c\x85\u200b\u2003")), max_size=300)


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_small_leaves_agree_with_the_library(text):
    ids = TREE.encode(text)
    assert ids == TREE.bpe.encode_ordinary(text)
    assert TREE.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("thereandzé")), min_size=50, max_size=2000))
def test_one_long_match_is_joined_over_its_bytes(text):
    assert TREE.encode_match(text.encode()) == TREE.direct(text.encode())


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 30_000 + "x", "there " * 9000, "!?" * 20_000, "x\n" * 9001])
def test_very_long_texts(text):
    tree = TreeBpe()
    assert tree.encode(text) == tree.bpe.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(MIXED)
def test_results_do_not_depend_on_the_leaves(text):
    want = TREE.bpe.encode_ordinary(text)
    assert [tree.encode(text) for tree in TREES] == [want] * len(TREES)


def test_every_text_beyond_a_leaf_goes_through_the_tree(spark):
    texts = ["word " * 13, "word " * 600, "a" * 65, "fits a leaf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joins = {r.doc_id: r.n_joins for r in round_trip(docs).collect()}
    assert joins[0] == 1 and joins[1] == 63 and joins[2] > 1 and joins[3] == 0


def test_frames_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, "the end", "n"), (3, "the end", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(map(tuple, round_trip(docs).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert out[0] == (1, 0, empty, empty, 0) and out[1] == (2, 0, empty, empty, 0)
    assert out[2] == out[3] and out[2][3] == hashlib.sha256(b"the end").hexdigest()
    assert round_trip(docs.limit(0)).count() == 0
    assert [r.ids for r in encode_column(docs.where("doc_id = 3")).collect()] == [TREE.encode("the end")] * 2
