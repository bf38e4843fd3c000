"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled training text accepts every substring of it. A text is
parsed greedily into phrases, each the longest match that starts where the last one ended; a symbol
that no training text holds is a phrase of its own. Fewer phrases mean a smaller cross entropy: phrases
times log2 of the automaton's text length, over the symbols parsed. The language with the least such
entropy wins, ties to the name that comes first; its score is its inverse entropy's share of the best
two (0.5: a tie; towards 1: no rival).

Texts are folded to the symbols of the training text: letters in lower case, everything else one
separator that never repeats. Whole texts are parsed, in pieces of PIECE symbols that start afresh, so
that pieces of many texts advance in step, one array operation per symbol; a text's phrase count is the
sum over its pieces.

Training: the whole texts of at most PER_LANGUAGE documents of each language, first by a hash of their ids.
More than MOST_LANGUAGES labelled languages are an error, not a cut: every task holds all automata, and the
parameter says for how many there is room. Passages of other languages are taken out of the training text
of each language that has two documents or more. Automata are built once, on the driver, and broadcast; their
transitions are kept in hash tables, so their size follows the text, not the alphabet.

Defined cases: null texts and texts without a letter are `und` with score 0; so is every text if nothing is
labelled; labels that are null or blank don't count, others are taken as they are; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import fold, sized_batches, texts_of

#: Bounds of the training sample: documents of each language, and languages.
PER_LANGUAGE, MOST_LANGUAGES = 24, 400
PIECE = 256
FOLDS, HELD_OUT = 4, 2


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to lower-case code point for letters, else 0; lower case that is not one letter stays."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    # beyond lie ideographs only
    out[0x30000:0x323B0] = np.arange(0x30000, 0x323B0)
    return out


def folded(text: str) -> np.ndarray:
    """Letters in lower case as code points; runs of anything else as one 0; 0 at either end."""
    points = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    points = np.r_[np.uint32(0), points, np.uint32(0)]
    return points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]


class SuffixAutomaton:
    """Accepts the substrings of a symbol sequence. States are numbered from 0, the empty string.

    Transitions stand in a hash table by state * alphabet + symbol, at the first free place from the key's own on."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        goes, link, length, last = [{}], [-1], [0], 0
        for s in symbols.tolist():
            new = len(goes)
            goes.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in goes[p]:
                goes[p][s] = new
                p = link[p]
            if p >= 0:
                q = goes[p][s]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(goes)
                    goes.append(dict(goes[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and goes[p].get(s) == q:
                        goes[p][s] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.alphabet = alphabet
        self.first = np.full(alphabet, -1, dtype=np.int32)  # transitions of state 0
        for s, to in goes[0].items():
            self.first[s] = to
        sizes = np.array([len(row) for row in goes], dtype=np.int64)
        keys = np.fromiter((s for row in goes for s in row), np.int64, int(sizes.sum())) + np.repeat(np.arange(len(goes)), sizes) * alphabet
        ends = np.fromiter((to for row in goes for to in row.values()), np.int32, keys.size)
        self.bits = max(4, int(3 * keys.size).bit_length())
        self.keys, self.ends = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        at = self._place(keys)
        while keys.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several at one place, one stays
            there = self.keys[at] == keys
            self.ends[at[there]] = ends[there]
            keys, ends, at = keys[~there], ends[~there], (at[~there] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state of each, or -1."""
        keys = states.astype(np.int64) * self.alphabet + symbols
        at = self._place(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ends[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            found = seen == keys[open_]
            out[open_[found]] = self.ends[at[open_[found]]]
            open_ = open_[~found & (seen >= 0)]
        return out


class Parser:
    """Automata of all languages over one alphabet: symbol 0 separates, the last is any unknown letter."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        texts = {lang: folded(training[lang]) for lang in self.languages}
        letters = np.unique(np.concatenate([np.zeros(1, np.uint32), *texts.values()]))
        self.letters, self.unknown = letters, len(letters)
        self.automata = [SuffixAutomaton(np.searchsorted(letters, texts[x]), len(letters) + 1) for x in self.languages]
        self.bits = np.array([np.log2(max(2, len(texts[x]))) for x in self.languages])

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at, self.unknown)

    def phrases(self, automaton: SuffixAutomaton, columns: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Phrase counts of pieces in step. columns: symbols by place and piece, longest pieces first;
        alive: how many pieces reach each place."""
        state = np.zeros(columns.shape[1], dtype=np.int32)
        count = np.ones(columns.shape[1], dtype=np.int32)
        for row, n in zip(columns, alive, strict=True):
            symbols = row[:n]
            to = automaton.step(state[:n], symbols)
            ended = np.flatnonzero(to < 0)
            # a phrase ends before this symbol, which begins the next one (or is unknown: a phrase alone)
            count[ended] += state[ended] > 0
            begun = automaton.first[symbols[ended]]
            count[ended] += begun < 0
            to[ended] = np.maximum(begun, 0)
            state[:n] = to
        return count - (state == 0)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol for each text and language; which texts have a letter."""
        points = [folded(t) for t in texts]
        lettered = np.array([bool(p.any()) for p in points], dtype=bool)
        sizes = np.array([p.size for p in points], dtype=np.int64)
        out = np.full((len(texts), len(self.languages)), np.inf)
        if not lettered.any() or not self.languages:
            return out, lettered
        data = self.symbols(np.concatenate(points)).astype(np.int32)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(owner.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE
        length = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        places = np.arange(length[0])
        columns = data[np.minimum(begin[None, :] + places[:, None], data.size - 1)]
        alive = np.searchsorted(-length, -places, side="left")
        for j, automaton in enumerate(self.automata):
            total = np.bincount(owner, self.phrases(automaton, columns, alive), minlength=len(texts))
            out[:, j] = total * self.bits[j] / sizes
        return out, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bits, lettered = self.entropies(texts)
        known = lettered & (len(self.languages) > 0)
        score = np.zeros(len(texts))
        names = ["und"] * len(texts)
        for i in np.flatnonzero(known):
            best = int(bits[i].argmin())
            rivals = np.sort(bits[i])[:2]
            names[i] = self.languages[best]
            score[i] = 1.0 if rivals.size < 2 else (1 / rivals[0]) / (1 / rivals[0] + 1 / rivals[1])
        return names, score


def cleaned(training: dict[str, list[str]], size: int = PIECE) -> dict[str, str]:
    """Training text without passages of other languages, which documents of any language may hold.

    Documents are dealt into two halves; each half's pieces are parsed by automata of the other, and stay if
    their own language explains them best. A language of one document takes part as a rival and keeps all, as
    does one that would lose most of its pieces."""
    whole = {lang: "\n".join(texts) for lang, texts in training.items()}
    several = [lang for lang, texts in training.items() if len(texts) > 1]
    if len(training) < 2:
        return whole
    kept: dict[str, list[str]] = {lang: [] for lang in several}
    total = dict.fromkeys(several, 0)
    for half in (0, 1):
        parser = Parser({lang: "\n".join(texts[1 - half :: 2] if lang in kept else texts) for lang, texts in training.items()})
        for lang in several:
            text = "\n".join(training[lang][half::2])
            pieces = [text[i : i + size] for i in range(0, len(text), size)]
            total[lang] += len(pieces)
            names, _ = parser.predict(pieces)
            kept[lang] += [p for p, name in zip(pieces, names, strict=True) if name == lang]
    return whole | {lang: "\n".join(kept[lang]) for lang in several if 2 * len(kept[lang]) > total[lang]}


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> dict[str, str]:
    """Training text by language. Ids are chosen first, from narrow rows; then only their texts are read."""
    turn = W.partitionBy("lang").orderBy("turn", "doc_id")
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
        .where("doc_id IS NOT NULL AND trim(lang) <> ''")
        .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .distinct()
        .withColumn("turn", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .withColumn("nth", F.row_number().over(turn))
        .where(F.col("nth") <= per_language)
        .select("doc_id", "lang", "nth")
    )
    rows = chosen.limit(per_language * most_languages + 1).collect()
    if len({r.lang for r in rows}) > most_languages:
        raise ValueError(f"more than {most_languages} languages are labelled")
    if not rows:
        return {}
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.lang, r.nth) for r in rows], "doc_id long, lang string, nth int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(wanted), ["doc_id", "lang"])  # the sample's bound
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r.lang, r.nth, r.text or "")):
        if r.text:
            out.setdefault(r.lang, []).append(r.text)
    return cleaned(out)


def identify(docs: DataFrame, training: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    training = training_texts(docs) if training is None else training
    shared = docs.sparkSession.sparkContext.broadcast(Parser(training))  # as large as the sample's bound allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in sized_batches(batches, "text", 1 << 20):
            names, score = parser.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_language_parse(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
