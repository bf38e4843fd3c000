"""The composed machine equals the cascade of its parts; the grammar ranks clauses; labels add words and weights."""

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np

from strandlake.llm import toxicity_fst as t


def test_composition_equals_running_the_parts_in_turn():
    machine, parts = t.grammar(), [t.reported_speech(), t.negation(), t.target(), t.insult(t.PRIOR), t.threat(t.PRIOR)]
    for symbols in itertools.product(t.SYMBOLS, repeat=4):
        text, total = "".join(symbols), 0.0
        for part in parts:
            text, weight = part.run(text)
            total += weight
        out, found = machine.run(symbols)
        assert out == text and abs(found - total) < 1e-9


def test_grammar():
    s = t.Scorer()
    plain, aimed = s.score("an idiot came"), s.score("you are an idiot")
    assert aimed > plain > s.score("not an idiot") == s.score("it said an idiot came")
    assert s.score("I will kill you") > 0.5 > s.score("kill the process")
    assert s.score("the weather is fine") == s.score("") < 0.5
    assert s.score("fine. " * 5000 + "you stupid moron.") > 0.5, "the end of a long text counts"
    # a clause end closes the reach of a target
    assert s.score("you. idiot") == plain


def test_one_isolated_word_does_not_decide():
    s = t.Scorer()
    assert all(s.score(x) < 0.5 for x in ("take out the trash. " + "the weather is fine. " * 40, "the clown waved", "viel Müll lag da", "they quoted you: idiot"))
    assert s.score("a stupid clown") > 0.5 and s.score("stupid. a clown") > 0.5, "a second match, in the clause or in another"
    assert s.score("you\u2019re trash") == s.score("you're trash") > 0.5


def _sentences(draw):
    """Toxic where the insult is aimed and neither negated nor reported."""
    filler = lambda: draw.choice("river stone market window garden winter letter bridge".split())
    insult, kind = draw.choice(["idiot", "moron", "clown"]), draw.randrange(5)
    said = [f"the {filler()} {filler()} you {insult} {filler()}", f"the {filler()} not the {insult}", f"you reported the {insult} {filler()}", f"the {insult} saw a {filler()} {filler()}", f"you never a {insult} {filler()}"][kind]
    return f"The {filler()} is near a {filler()}. {said}. A {filler()} it was", int(kind == 0)


def test_each_part_of_the_grammar_changes_held_out_verdicts(spark):
    draw = random.Random(8)
    rows = [(i, *_sentences(draw)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = {}
    for without in (None, *t.PARTS[:3]):
        scorer = t.learn(docs, labels, parts=tuple(p for p in t.PARTS if p != without))
        right[without] = sum((scorer.score(text) >= 0.5) == y for _, text, y in held)
    assert right[None] == len(held) > 150
    assert all(right[p] < 0.95 * len(held) for p in t.PARTS[:3]), right


def test_lexicon_equals_brute_force(spark):
    draw, letters = random.Random(9), "abcdefgh"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    bad, common = [f"zurgl{x}" for x in "abcdef"] + ["mopf", "grib"], [word(5) for _ in range(40)] + ["zurgling"[:5] + "x"]
    rows = []
    for i in range(240):
        words = [draw.choice(common) for _ in range(12)]
        if i % 2:
            words[draw.randrange(12)] = draw.choice(bad)
            words[draw.randrange(12)] = draw.choice(bad)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "quib quab quob") for i in range(10)]  # copies
    classes = {i: 1 if i >= 1000 else i % 2 for i, _ in rows}
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    contexts, clean = defaultdict(set), defaultdict(set)
    for i, text in rows:
        words = text.split()
        for k, w in enumerate(words):
            if not classes[i]:
                clean[w].add(i)
            elif w not in words[k + 1 :]:
                contexts[w].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    toxic, n_clean = sum(classes.values()), sum(1 - y for y in classes.values())
    seen = t.word_contexts(texts, classes)
    assert {(r.word, r.toxic, r.clean) for r in seen.collect()} == {(w, len(contexts[w]), len(clean[w])) for w in {*contexts, *clean}}
    odds = lambda w: math.log((len(contexts[w]) + 0.5) / (toxic + 1)) - math.log((len(clean[w]) + 1) / (n_clean + 2))
    want = sorted(w for w in contexts if len(contexts[w]) >= t.MIN_CONTEXTS and odds(w) >= t.MIN_WEIGHT)
    learned, stems = t.learned_lexicon(seen, toxic, n_clean)
    assert learned == want and len(want) >= 5 and {*want} <= {*bad}
    begins = {w[:n] for w in want for n in range(t.STEM, len(w) + 1)}
    good = {b for b in begins if sum(w.startswith(b) for w in want) >= t.STEM_WORDS and not any(w.startswith(b) for w in clean)}
    assert set(stems) == {b for b in good if b[:-1] not in good}


def test_fitted_weights_are_a_minimum():
    draw = np.random.default_rng(4)
    documents, y = [], []
    for i in range(200):
        bad = i % 2
        documents.append(draw.integers(0, 2, (draw.integers(0, 3) + bad, len(t.KINDS))).astype(float) * (1 if bad else draw.random() < 0.5))
        y.append(bad)
    y, share = np.array(y, float), 0.3
    found = t.fitted(documents, y, share)

    def loss(w):
        total = 0.0
        for d, c in zip(documents, y, strict=True):
            worth = d @ np.array([w[k] for k in t.KINDS])
            z = w["base"] + (t.REST * worth.sum() + (1 - t.REST) * worth.max() if len(d) else 0.0)
            total += (share / y.mean() if c else (1 - share) / (1 - y.mean())) * (math.log1p(math.exp(z)) - c * z)
        return total + t.STRENGTH / 2 * sum((w[k] - t.PRIOR[k]) ** 2 for k in t.PRIOR)

    def allowed(w):
        return all(w[k] >= 0 for k in t.KINDS) and all(w[k] <= -w["base"] - t.MARGIN + 1e-9 for k in "12k") and all(w[b] >= w[a] for a, b in zip("123k", "ABCK", strict=True))

    assert allowed(found)
    least = loss(found)
    for k in found:
        for step in (-0.05, 0.05):
            near = found | {k: found[k] + step}
            assert not allowed(near) or loss(near) > least - 0.02, (k, step)


def _corpus(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, f"w{i * 7 % 31} " + (f"zorgish{i % 3} " if bad else "plain ") + f"x{i * 11 % 37} said", "a", 0))
        labels.append((i, 1, bad))
    rows += [(1000, None, "a", 0), (1001, "", None, 0), (1002, "x. " * 20000 + "a zorgish1 b", "a", 0), (1002, "ok", "b", 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, source string, score int").repartition(3),
        spark.createDataFrame(labels + [(None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int"),
    )


def test_learned_words_on_held_out_rows(spark):
    docs, labels = _corpus(spark)
    out = t.score_documents(docs, labels).collect()
    assert len(out) == 404
    held = [r for r in out if r.doc_id < 400 and r.held_out]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sorted(r.predicted for r in out if r.doc_id == 1002) == [0, 1]
    assert all(r.predicted == 0 for r in out if r.doc_id in (1000, 1001))
    kept = t.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == 200
    assert t.score_documents(docs.limit(0), labels).count() == 0
    assert t.score_documents(docs, labels.limit(0)).count() == 404


def test_copies_of_one_text_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "brixle dromt vask" if i % 2 else f"good {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    scorer = t.learn(docs, labels)
    assert scorer.score("brixle") == scorer.score("other")
