"""Counts equal the library's for every kind of text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import token_counts as tc

LIBRARY = Tokenizer.from_file(tc.TOKENIZER)
SPECIALS = tc.special_strings(tc.TOKENIZER)


def direct(texts):
    data, lists = tc.block_row(list(range(len(texts))), texts, SPECIALS, 7)
    count = [n for x in sorted(lists, key=lambda x: x["bucket"]) for n in tc.pieces(tc.unpack_words(x["words"]), tc.TOKENIZER)]
    ids, _, size, special, rows, step, freq = tc.unpack(data, 7)
    out, at, place = [], 0, step.cumsum()
    for i in range(len(ids)):
        out.append(int(special[i] + sum(freq[j] * count[place[j]] for j in range(at, at + rows[i]))))
        at += rows[i]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abethn 's\n\t  é1!_ß中😀\x1c\x00\x85")), max_size=80), max_size=5))
def test_counts_equal_the_library(texts):
    assert direct(texts) == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("text", ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext", "it's   we'll\n\n x "])
def test_special_strings_count_as_the_library_has_them(text):
    assert direct([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_frames(spark):
    texts = [None, "", "the end", "the end", "<|endoftext|> é " * 9, "word " * 30_000, "x" * 5000, " \n" * 400]
    rows = [(i, t, "b", 7) for i, t in enumerate(texts)] + [(2, "again, twice", "b", 7), (None, "no id", None, None), (-(2**63), "least id", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_tokens int").repartition(3)
    got = sorted(map(tuple, tc.count_tokens(docs, block=64).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert tc.count_tokens(docs.limit(0)).count() == 0
