"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (2; 3: one that labels show to be toxic on its own), threat verbs (k), targets
(t), negations (n), reporting words (r), clause ends (.) and others (o). Five transducers over these symbols
are composed into one machine, ahead of time:

    reported speech   what follows a reporting word in its clause is one strength weaker (3, 2, 1, none)
    negation          so is what follows a negation within REACH words
    target            an insult or threat near a target is marked (A, B, C, K; T: the target after it)
    insult, threat    weigh the insults and threats that are left, by one weight per kind of match

The machine runs over each clause that holds an insult or threat; a clause's weight is its path's. A
document's log-odds of being toxic are `base`, the weight of its worst clause and REST of that of the
others. A clean document has no such clause, and costs a set lookup per word.

The fixed words and PRIOR, the arcs' weights, are where learning starts. From a bounded sample (at most
PER_CLASS documents of each class, whole texts) the labels add:

* words: Spark counts in how many different contexts, the words before and after it, a word occurs in toxic
  documents, and in how many clean documents it occurs. Contexts, not documents, so that copies of one toxic
  text don't teach its ordinary words. Words with at least MIN_CONTEXTS contexts and a log-odds ratio of at
  least MIN_WEIGHT join the insults; where three of them share a beginning of STEM letters or more that no
  clean word has, that stem joins too;
* which words decide alone: those that are a document's only match in at least MIN_CONTEXTS contexts, of which
  at least ALONE are toxic;
* the arcs' weights and the base: the log loss over the sample, both classes weighing as they do among all
  rows that may teach, with a normal prior around PRIOR, is minimised by projected gradient steps. Weights
  aren't negative, a target never lessens one, and a single unmarked insult of less than strength 3 stays
  below the threshold: isolated words don't decide unless labels show that they do.

Defined cases: null and empty texts get the score of a document without matched clauses; without labels of
both classes the fixed words and weights alone decide; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import fold, sized_batches, spill_table, texts_of
from strandlake.llm.labelled import labelled_ids, sampled_texts

# The seed lexicon.
INSULTS = (
    "idiot idiots moron morons stupid scum trash loser losers clown clowns pathetic worthless disgusting dumb fool imbecile "
    "idiota imbécil estúpido estúpida basura payaso asqueroso patético inútil "
    "dumm dummkopf abschaum müll versager widerlich erbärmlich wertlos "
    "imbécile crétin déchet raclure dégoûtant pathétique"
).split()
THREATS = "kill hurt destroy strangle stab punch matar golpear töten umbringen tuer frapper".split()
TARGETS = "you your you're u they them he she him her people everyone tú usted ellos du dich sie ihr tu toi vous ils eux".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody nunca jamás nicht kein keine nie pas jamais aucun".split()
REPORTING = "said says wrote called calls claimed quoted quote reported according dijo llamó sagte nannte schrieb dit appelé".split()

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 2500
MIN_CONTEXTS, MIN_WEIGHT, ALONE = 6, 3.2, 0.8
STEM, STEM_WORDS = 5, 3
REACH = 3
REST = 0.5
THRESHOLD = 0.5
SYMBOLS = "123ktnr.o"
#: Weights by kind of match, and the base, where learning starts. 123: insults by strength, ABC: near a target,
#: T: a target after an insult or threat, k and K: a threat, without and with a target before it, kT: one that a target follows.
PRIOR = {"1": 0.6, "2": 1.6, "3": 2.0, "A": 1.8, "B": 4.0, "C": 5.0, "T": 0.5, "k": 0.3, "K": 3.0, "kT": 3.0, "base": -2.2}
MARGIN = 0.2
STEPS, RATE, STRENGTH = 400, 0.05, 1.0
#: The transducers in order of composition; `insult` and `threat` weigh, the others mark.
PARTS = ("reported speech", "negation", "target", "insult", "threat")

_WORD = re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)?|[.!?;:\n]")


def words_of(text: str) -> list[str]:
    """Words in lower case, and clause ends; either apostrophe is the ASCII one."""
    return _WORD.findall(text.lower().replace("\u2019", "'"))


class Fst:
    """A deterministic transducer: arcs[state][symbol] = (next state, output symbol, weight); state 0 starts.

    Weights add up along a path: numbers, or vectors, such as one with a place for each kind of match."""

    def __init__(self, arcs: list[dict[str, tuple[int, str, Any]]]):
        self.arcs = arcs

    def run(self, symbols: Iterable[str]) -> tuple[str, Any]:
        state, out, total = 0, [], 0.0
        for symbol in symbols:
            state, written, weight = self.arcs[state][symbol]
            out.append(written)
            total = total + weight
        return "".join(out), total

    def compose(self, after: Fst) -> Fst:
        """This machine's output is the other's input; only reachable pairs of states are built."""
        number, queue, arcs = {(0, 0): 0}, deque([(0, 0)]), []
        while queue:
            a, b = queue.popleft()
            row = {}
            for symbol, (to_a, middle, weight_a) in self.arcs[a].items():
                to_b, written, weight_b = after.arcs[b][middle]
                if (to_a, to_b) not in number:
                    number[to_a, to_b] = len(number)
                    queue.append((to_a, to_b))
                row[symbol] = (number[to_a, to_b], written, weight_a + weight_b)
            arcs.append(row)
        return Fst(arcs)


_WEAKER = {"1": "o", "2": "1", "3": "2", "k": "o"}


def reported_speech() -> Fst:
    plain = {s: (1 if s == "r" else 0, s, 0.0) for s in SYMBOLS}
    inside = {s: (0 if s == "." else 1, _WEAKER.get(s, s), 0.0) for s in SYMBOLS}
    return Fst([plain, inside])


def negation(reach: int = REACH) -> Fst:
    """State i: a negation stands i words back; 0: none within reach."""
    arcs = [{s: (1 if s == "n" else 0, s, 0.0) for s in SYMBOLS}]
    for i in range(1, reach + 1):
        arcs.append({s: (0 if s == "." else 1 if s == "n" else (i + 1) % (reach + 1), _WEAKER.get(s, s), 0.0) for s in SYMBOLS})
    return Fst(arcs)


def target(reach: int = REACH) -> Fst:
    """States 1..reach: a target stands that far back. The next reach: an insult or threat does."""
    strong = "123k"

    def row(seen: int, struck: int) -> dict[str, tuple[int, str, float]]:
        out = {}
        for s in SYMBOLS:
            if s == ".":
                out[s] = (0, s, 0.0)
            elif s == "t":
                out[s] = (1, "T" if struck else s, 0.0)
            elif s in strong:
                out[s] = (1 + reach, s.translate(_MARK) if seen else s, 0.0)
            else:
                out[s] = (seen + 1 if 0 < seen < reach else 1 + reach + struck if 0 < struck < reach else 0, s, 0.0)
        return out

    return Fst([row(0, 0), *(row(i, 0) for i in range(1, reach + 1)), *(row(0, i) for i in range(1, reach + 1))])


#: Marked forms: an insult or threat that a target precedes.
_MARK = str.maketrans("123k", "ABCK")
_MARKED = SYMBOLS + "ABCKT"


def insult(weights: dict[str, Any]) -> Fst:
    return Fst([{s: (0, s, weights[s] if s in "123ABCT" else 0.0) for s in _MARKED}])


def threat(weights: dict[str, Any]) -> Fst:
    """A threat weighs by itself, and more once a target follows it in its clause."""
    own = {s: weights[s] if s in "kK" else 0.0 for s in _MARKED}
    calm = {s: (1 if s in "kK" else 0, s, own[s]) for s in _MARKED}
    raised = {s: (0 if s in ".T" else 1, s, weights["kT"] if s == "T" else own[s]) for s in _MARKED}
    return Fst([calm, raised])


def grammar(weights: dict[str, Any] = PRIOR, parts: tuple[str, ...] = PARTS) -> Fst:
    """The composed machine; parts left out of `parts` change nothing."""
    same = lambda symbols: Fst([{s: (0, s, 0.0) for s in symbols}])
    built = {"reported speech": reported_speech(), "negation": negation(), "target": target(), "insult": insult(weights), "threat": threat(weights)}
    machine = None
    for name in PARTS:
        part = built[name] if name in parts else same(SYMBOLS if name in PARTS[:3] else _MARKED)
        machine = part if machine is None else machine.compose(part)
    return machine


class Scorer:
    """Scores texts by a lexicon (fixed words, learned ones, those that decide alone, stems) and arc weights."""

    def __init__(self, learned: Iterable[str] = (), stems: tuple[str, ...] = (), alone: Iterable[str] = (), weights: dict[str, Any] = PRIOR, parts: tuple[str, ...] = PARTS):
        self.symbol = {}
        for words, symbol in ((TARGETS, "t"), (NEGATIONS, "n"), (REPORTING, "r"), (THREATS, "k"), (INSULTS, "2"), (learned, "2"), (alone, "3")):
            self.symbol |= dict.fromkeys(words, symbol)
        self.strong = frozenset(w for w, s in self.symbol.items() if s in "23k")
        self.stems = stems
        self.stem = re.compile(r"\b(?:" + "|".join(map(re.escape, stems)) + ")") if stems else None
        self.weights = weights
        self.machine = grammar(weights, parts)

    def symbol_of(self, word: str) -> str:
        if word in ".!?;:\n":
            return "."
        return self.symbol.get(word) or ("2" if self.stems and word.startswith(self.stems) else "o")

    def matches(self, text: str) -> list[str]:
        """The text's words and clause ends if any of them is an insult or threat, else nothing."""
        words = words_of(text)
        return [] if self.strong.isdisjoint(words) and not (self.stem and self.stem.search(text.lower())) else words

    def clauses(self, text: str) -> list[Any]:
        """Weights of the clauses that hold an insult or threat."""
        found, clause = [], []
        for symbol in [*map(self.symbol_of, self.matches(text)), "."]:
            clause.append(symbol)
            if symbol == ".":
                if not {"2", "3", "k"}.isdisjoint(clause):
                    found.append(self.machine.run(clause)[1])
                clause = []
        return found

    def score(self, text: str) -> float:
        weights = self.clauses(text)
        odds = self.weights["base"] + (max(weights) + REST * (sum(weights) - max(weights)) if weights else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


KINDS = tuple(k for k in PRIOR if k != "base")
#: Weights by which a path counts its matches instead of weighing them.
COUNTING = {k: np.eye(len(KINDS))[i] for i, k in enumerate(KINDS)} | {"base": 0.0}


def fitted(documents: list[np.ndarray], y: np.ndarray, share: float) -> dict[str, float]:
    """Arc weights and base from the counts of matches in each document's clauses (clauses x KINDS).

    share: the weight of class 1 among both."""
    prior = np.array([PRIOR[k] for k in KINDS] + [PRIOR["base"]])
    at, weak = {k: i for i, k in enumerate(KINDS)}, [KINDS.index(k) for k in "12k"]
    clauses = np.concatenate([np.zeros((0, len(KINDS))), *documents])
    sizes = np.array([len(d) for d in documents])
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    totals = np.add.reduceat(clauses, starts, axis=0) if some.size else clauses
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    now, m, v = prior.copy(), np.zeros(prior.size), np.zeros(prior.size)
    for step in range(1, STEPS + 1):
        counts = np.zeros((len(documents), len(KINDS)))
        if some.size:
            worth = clauses @ now[:-1]
            ends = np.r_[starts[1:], len(clauses)]
            worst = np.array([lo + int(worth[lo:hi].argmax()) for lo, hi in zip(starts, ends, strict=True)])
            counts[some] = REST * totals + (1 - REST) * clauses[worst]
        odds = counts @ now[:-1] + now[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
        grad = np.r_[slope @ counts, slope.sum()] + STRENGTH * (now - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        now = now - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / math.sqrt(1 + step / 50)
        now[-1] = min(now[-1], -MARGIN)
        now[:-1] = np.maximum(now[:-1], 0)
        now[weak] = np.minimum(now[weak], -now[-1] - MARGIN)
        for plain, marked in zip("123k", "ABCK", strict=True):
            now[at[marked]] = max(now[at[marked]], now[at[plain]])
    return dict(zip((*KINDS, "base"), now.tolist(), strict=True))


def shared_stems(begins: dict[str, int], clean: Iterable[str]) -> tuple[str, ...]:
    """Shortest beginnings that at least STEM_WORDS learned words (begins: how many) and no clean word have."""
    clean = set(clean)
    good = {s for s, c in begins.items() if c >= STEM_WORDS and s not in clean}
    return tuple(sorted(s for s in good if s[:-1] not in good))


def _rows(columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def word_contexts(texts: DataFrame, classes: dict[int, int]) -> DataFrame:
    """(word, toxic, clean): different contexts in toxic documents, and clean documents, of every word of the sample."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = [w for w in words_of(text) if w not in ".!?;:\n"]
                if classes[doc_id]:
                    # one context of each word and document: contexts count no more than documents do
                    rows += [(w, 1, c) for w, c in {w: f"{a} {b}" for a, w, b in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True)}.items()]
                else:
                    rows += [(w, 0, str(doc_id)) for w in set(words)]
            yield _rows([[r[i] for r in rows] for i in range(3)], ["word", "y", "place"], [pa.string(), pa.int32(), pa.string()])

    seen = texts.mapInArrow(contexts, "word string, y int, place string").distinct()
    return seen.groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def learned_lexicon(seen: DataFrame, toxic: int, clean: int) -> tuple[list[str], tuple[str, ...]]:
    """Words and stems that the counts of word_contexts over so many documents make insults."""
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 1) / (clean + 2))
    # the sample bounds how many words have enough contexts
    learned = sorted(r.word for r in seen.where((F.col("toxic") >= MIN_CONTEXTS) & (weight >= MIN_WEIGHT)).select("word").collect())
    begins = Counter(w[:n] for w in learned for n in range(STEM, len(w) + 1))
    begins = {s: c for s, c in begins.items() if c >= STEM_WORDS}
    if not begins:
        return learned, ()
    wanted = seen.sparkSession.createDataFrame([(s,) for s in begins], "begin string")
    starts = F.transform(F.sequence(F.lit(STEM), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    theirs = seen.where((F.col("clean") > 0) & (F.length("word") >= STEM)).select(F.explode(starts).alias("begin")).join(wanted, "begin", "left_semi").distinct()
    return learned, shared_stems(begins, [r.begin for r in theirs.collect()])


def lone_words(texts: DataFrame, classes: dict[int, int], scorer: Scorer) -> list[str]:
    """Words that decide alone: as a document's only match, in enough contexts, they are mostly toxic."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = scorer.matches(text)
                at = [i for i, w in enumerate(words) if scorer.symbol_of(w) == "2"]
                if len(at) == 1:
                    i = at[0]
                    rows.append((words[i], classes[doc_id], " ".join([*words[max(0, i - 1) : i], "", *words[i + 1 : i + 2]])))
            yield _rows([[r[j] for r in rows] for j in range(3)], ["word", "y", "place"], [pa.string(), pa.int32(), pa.string()])

    found = texts.mapInArrow(single, "word string, y int, place string").distinct()
    sums = found.groupBy("word").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    return sorted(r.word for r in sums.where((F.col("toxic") >= MIN_CONTEXTS) & (F.col("toxic") >= ALONE * F.col("n"))).select("word").collect())


def match_counts(texts: DataFrame, classes: dict[int, int], scorer: Scorer) -> tuple[list[np.ndarray], np.ndarray]:
    """The counts of matches in each sampled document's clauses, and the documents' classes. scorer: with weights COUNTING."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            found = [scorer.clauses(t) for t in texts_of(batch)]
            data = pa.array([np.array(c, dtype=np.uint16).tobytes() for c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "data"])

    rows = sorted((r.doc_id, bytes(r.data)) for r in texts.mapInArrow(count, "doc_id bigint, data binary").collect())
    return [np.frombuffer(d, np.uint16).reshape(-1, len(KINDS)).astype(float) for _, d in rows], np.array([classes[i] for i, _ in rows], float)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, parts: tuple[str, ...] = PARTS) -> Scorer:
    classes, share = labelled_ids(docs, labels, label, per_class, FOLDS, HELD_OUT)
    toxic = sum(classes.values())
    clean = len(classes) - toxic
    if not toxic or not clean:
        return Scorer(parts=parts)
    texts = spill_table(sampled_texts(docs, classes), "toxicity-sample")
    seen = spill_table(word_contexts(texts, classes), "toxicity-words")
    learned, stems = learned_lexicon(seen, toxic, clean)
    alone = lone_words(texts, classes, Scorer(learned, stems, parts=parts))
    weights = fitted(*match_counts(texts, classes, Scorer(learned, stems, alone, COUNTING, parts)), share)
    return Scorer(learned, stems, alone, weights, parts)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scorer = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(t) for t in texts_of(batch)], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with their columns, whose text scores below the threshold."""
    scorer = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity_fst(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
