"""Components equal brute force over all pairs, on texts made to be near the threshold."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import jaccard_join as j
from strandlake.llm.common import SPACE_BYTES, shingle_sets
from strandlake.llm.graph import components


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in SPACE_BYTES:
        low = low.replace(chr(b), " ")
    return [w for w in low.split(" ") if w]


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_force(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(rows[i][0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((rows[i][0], len(sets[i]), least(group[find(i)])) for i in range(len(rows))), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB c\t\n\x0bé\xa0", max_size=40), max_size=5), st.integers(1, 4))
def test_shingle_sets(texts, k):
    bounds, hashes = shingle_sets([t.encode() for t in texts], k)
    assert np.diff(bounds).tolist() == [len(shingles(t, k)) for t in texts]
    assert (bounds[-1] == hashes.size) if texts else True


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200)), st.sets(st.integers(0, 200)), st.integers(50, 100))
def test_linked_and_suffix_filter(a, b, percent):
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
    assert j.overlap_bound(x, y, 0) >= len(a & b)
    if a and b:
        assert j.linked(x, y, percent) == (100 * len(a & b) >= percent * len(a | b))


def _texts(seed, groups=6, copies=9, length=80):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    passage = [draw.choice(vocabulary) for _ in range(25)]
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(length // 2, length))]
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(text))
                text[at : at + draw.randint(0, 1)] = [draw.choice(vocabulary)]
            if draw.random() < 0.3:
                text = text + passage
            rows.append((i, " ".join(text)))
            base = text if draw.random() < 0.3 else base  # chains, not only stars
            i += 1
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 70), (4, 1, 60)])
def test_components_equal_brute_force(spark, seed, k, percent):
    rows = _texts(seed)
    rows += [(500, None), (501, ""), (502, "Ab"), (503, "aB"), (504, "a b"), (3, rows[0][1]), (505, " \t\n"), (506, "a\x0bb"), (None, rows[1][1]), (507, "long " + "tail " * 20_000)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, rid string").repartition(3)
    got = j.similar_groups(docs, k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, k, percent)


def test_several_rounds(spark, monkeypatch):
    """Members that link with one another but not with their bucket's leader are found in later rounds."""
    draw = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(8):
        own = [f"g{g}w{i}" for i in range(30)]
        for c in range(4):
            rows.append((len(rows), " ".join(common + own + [f"x{draw.randrange(10**6)}"] * (c % 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(j, "shingle_rarity", lambda docs, words: np.zeros(1 << j.TABLE_BITS, np.uint8))  # no help from frequencies
    got = j.similar_groups(docs, 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 3, 90)


def test_empty_and_filtering(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, None, "t"), (4, "other words here for once now", None)], "doc_id long, text string, source string")
    assert j.similar_groups(docs.limit(0), 3, 90).count() == 0
    kept = j.one_of_each_group(docs)
    assert kept.columns and set(kept.columns) == set(docs.columns) and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7_000), (7_000, 200), (5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 7000: 100}


@pytest.mark.parametrize("seed,k,percent,cell", [(5, 3, 90, 128), (2, 5, 80, 2)])
def test_every_link_is_counted(spark, monkeypatch, seed, k, percent, cell):
    """Also those between texts that other links connect already."""
    monkeypatch.setattr(j, "CELL", cell)
    rows = _texts(seed, groups=4, copies=12, length=120)
    rows += [(500, None), (501, "Ab"), (502, "aB"), (503, rows[0][1]), (504, rows[0][1].upper()), (None, rows[1][1])]
    sets = [shingles(t, k) for _, t in rows]
    count = [sum(bool(x) and a != b and 100 * len(x & y) >= percent * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    assert max(count) >= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = j.similar_groups(docs, k, percent, links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(((i, n) for (i, _), n in zip(rows, count, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, k, percent)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=6), st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=6))
def test_intersections(left, right):
    x, y = ([np.array(sorted(s), np.uint64) for s in side] for side in (left, right))
    assert j.intersections(x, y).tolist() == [[len(a & b) for b in right] for a in left]


def test_columns_that_clash_come_back_unchanged(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 777, 5), (2, text, 778, 6), (3, "other words", 779, 7)], "doc_id long, text string, _rid long, _RID_ long")
    assert sorted(map(tuple, j.one_of_each_group(docs).collect())) == [(1, text, 777, 5), (3, "other words", 779, 7)]
