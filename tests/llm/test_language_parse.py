"""Automata accept exactly the substrings; vectorised parsing equals a greedy parse; languages are told apart."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import language_parse as lp


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abcd", max_size=6))
def test_automaton_accepts_substrings(text, probe):
    to = {c: i for i, c in enumerate("abcd")}
    automaton = lp.SuffixAutomaton(np.array([to[c] for c in text]), 4)
    state = 0
    for c in probe:
        state = int(automaton.step(np.array([state]), np.array([to[c]]))[0]) if state >= 0 else -1
    assert (state >= 0) == (probe in text)
    assert all((automaton.first[to[c]] >= 0) == (c in text) for c in to)


def test_large_alphabets_take_no_dense_table():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 20_000, 30_000)
    automaton = lp.SuffixAutomaton(symbols, 20_001)
    assert automaton.keys.size < 20 * symbols.size
    state = np.zeros(1, np.int32)
    for s in symbols[500:560]:
        state = automaton.step(state, np.array([s]))
        assert state[0] > 0


def greedy(train: str, text: str) -> int:
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i = max(i + 1, j - 1)
        count += 1
    return count


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", max_size=60), st.lists(st.text("ab cz.", max_size=700), min_size=1, max_size=4))
def test_phrases_equal_a_greedy_parse(train, texts):
    parser = lp.Parser({"x": train, "y": "ab"})
    bits, lettered = parser.entropies(texts)
    flat = lambda t: "".join(chr(c) if c else " " for c in lp.folded(t))
    for i, text in enumerate(texts):
        whole = flat(text)
        expected = sum(greedy(flat(train), whole[k : k + lp.PIECE]) for k in range(0, len(whole), lp.PIECE))
        if lettered.any():
            assert np.isclose(bits[i, 0], expected * parser.bits[0] / len(whole))
        assert lettered[i] == any(c.isalpha() for c in text)


WORDS = {"aa": "the and of walking house".split(), "bb": "der und das häuser gehen".split(), "cc": "les dans maison où était".split()}


def _rows(n=240):
    draw = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(12)), lang, "s", 1.0))
    return out


def test_held_out_languages(spark):
    rows = _rows() + [(900, None, "aa", "s", 0.0), (901, "", None, "s", 0.0), (902, "12 !? 3", "bb", "s", 0.0), (903, "the house " * 20000, None, "s", 0.0), (904, "the", " ", None, None), (904, "the", "aa", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    out = lp.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "aa"
    held = [r for r in out if r.held_out and r.doc_id < 240]
    assert held and all(r.lang_pred == sorted(WORDS)[r.doc_id % 3] and 0.5 <= r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert lp.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in lp.identify(docs, {}).collect()} == {"und"}


def test_foreign_passages_leave_the_training_text():
    draw = random.Random(4)
    text = lambda lang, n: " ".join(draw.choice(WORDS[lang]) for _ in range(n))
    training = {lang: [text(lang, 200) for _ in range(6)] for lang in WORDS}
    training["cc"][2] += " " + text("aa", 200)
    found = lp.cleaned(training)
    count = lambda s, words: sum(w in words for w in s.split())
    assert count(found["cc"], WORDS["aa"]) < 60 and count(found["cc"], WORDS["cc"]) > 1000
    assert lp.cleaned({"aa": ["x y"], "bb": ["z"]}) == {"aa": "x y", "bb": "z"}
    # a language of one document doesn't switch the others' cleaning off
    found = lp.cleaned(training | {"dd": ["zz yy xx"]})
    assert count(found["cc"], WORDS["aa"]) < 60 and found["dd"] == "zz yy xx"


def test_labels_are_taken_as_they_are_and_too_many_are_an_error(spark):
    rows = [(i, f"{w} {w}", f" {w}", "s", 0.0) for i, w in enumerate(["house", "maison"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    assert {r.lang_pred for r in lp.identify(docs).collect()} == {" house", " maison"}
    try:
        lp.training_texts(docs, most_languages=1)
    except ValueError as e:
        assert "languages" in str(e)
    else:
        raise AssertionError("silently cut")
