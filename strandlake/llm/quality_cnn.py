"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the bytes of the UTF-8 text. A filter sees TAPS bytes, at every STRIDE-th place. Its
response is max-pooled over chunks of CHUNK bytes of which each overlaps the next by half and which
together cover the whole document. A document's features are, for every filter, the largest and the
mean of its chunks' responses after a rectifier; a logistic layer combines them into one probability.

Filters and head are learned by Adam on the log loss, on the whole texts of a bounded sample: at most
PER_CLASS labelled documents of each class, which the driver holds. The classes weigh as they do among
all labelled rows that may teach. Prediction reads every byte of every document, in blocks, also of a single long text.

Defined cases: null and empty texts are one chunk of padding and get that chunk's score; without rows
of both classes the score is the smoothed share of the class, (ones + 1) / (rows + 2); repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import fold, sized_batches, texts_of
from strandlake.llm.labelled import labelled_ids, sampled_texts

TAPS, STRIDE, FILTERS, CHUNK, SYMBOLS = 6, 2, 16, 512, 256
HALF = CHUNK // 2
#: Bound of the training sample: documents of each class.
PER_CLASS = 1500
EPOCHS, BATCH, RATE, SEED = 20, 100, 0.02, 7
#: Halves of chunks whose responses are held at a time.
BLOCK = 2048
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded by zeros to a multiple of HALF (one at least) and by HALF more, and
    each one's offset. CHUNK zeros follow the last, so that every window can be read."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.r_[0, np.cumsum(np.maximum(1, -(-lengths // HALF)) * HALF + HALF)]
    out = np.zeros(offsets[-1] + CHUNK, dtype=np.uint8)
    for text, at in zip(texts, offsets, strict=False):
        out[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out, offsets


def responses(tables: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Filters' responses at every STRIDE-th place of a flat array that ends in TAPS symbols of padding."""
    n = (symbols.size - TAPS) // STRIDE
    out = np.take(tables[0], symbols[: n * STRIDE : STRIDE], axis=0)
    for t in range(1, TAPS):
        out += np.take(tables[t], symbols[t : t + n * STRIDE : STRIDE], axis=0)
    return out


class Network:
    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.p = {
            "tables": draw.normal(0, 0.15, (TAPS, SYMBOLS, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "most": draw.normal(0, 0.3, FILTERS).astype(np.float32),
            "mean": draw.normal(0, 0.3, FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def pooled(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each chunk and filter, the place it comes from, and each text's first chunk.

        Chunk i of a text is its halves i and i + 1; a text's last half is padding and begins no chunk."""
        per_half, halves = HALF // STRIDE, int(offsets[-1]) // HALF
        best, place = np.empty((halves, FILTERS), np.float32), np.empty((halves, FILTERS), np.int64)
        # windows that would reach into the next text
        over = np.concatenate([offsets[1:] // STRIDE - back for back in range(1, (TAPS - 1) // STRIDE + 1)])
        for lo in range(0, halves, BLOCK):
            hi = min(halves, lo + BLOCK)
            raw = responses(self.p["tables"], symbols[lo * HALF : hi * HALF + TAPS])
            raw[over[(over >= lo * per_half) & (over < hi * per_half)] - lo * per_half] = -np.inf
            raw = raw.reshape(hi - lo, per_half, FILTERS)
            at = raw.argmax(axis=1)
            best[lo:hi] = np.take_along_axis(raw, at[:, None, :], axis=1)[:, 0]
            place[lo:hi] = at + (np.arange(lo, hi) * per_half)[:, None]
        begins = np.ones(halves, bool)
        begins[offsets[1:] // HALF - 1] = False
        first = np.flatnonzero(begins)
        second = best[first + 1] > best[first]
        counts = np.diff(offsets) // HALF - 1
        return np.where(second, best[first + 1], best[first]), np.where(second, place[first + 1], place[first]), np.cumsum(counts) - counts

    def logits(self, responses: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each text, with its features (largest and mean of the rectified responses) and its chunks."""
        active = np.maximum(responses + self.p["bias"], 0)
        count = np.diff(np.r_[starts, len(active)])[:, None].astype(np.float64)
        # sums in double precision: a text's score has the same bits in any block
        most = np.maximum.reduceat(active, starts, axis=0).astype(np.float64)
        mean = np.add.reduceat(active.astype(np.float64), starts, axis=0) / count
        return (most * self.p["most"] + mean * self.p["mean"]).sum(axis=1) + self.p["base"][0], most, mean, count

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        found, _, starts = self.pooled(*symbols_of(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(found, starts)[0], -30, 30)))

    def fit(self, texts: list[bytes], y: np.ndarray, share: float = 0.5, epochs: int = EPOCHS) -> Network:
        """share: the weight of class 1 among both."""
        draw, m, v, step = np.random.default_rng(SEED), {}, {}, 0
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                pick = order[lo : lo + BATCH]
                grads = self.gradients([texts[i] for i in pick], y[pick], weight[pick])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        symbols, offsets = symbols_of(texts)
        found, place, starts = self.pooled(symbols, offsets)
        logit, most, mean, count = self.logits(found, starts)
        slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y))[:, None]
        owner = np.repeat(np.arange(len(texts)), count[:, 0].astype(int))
        back = (slope * self.p["mean"] / count)[owner]
        ends = np.r_[starts[1:], len(found)]
        best = np.stack([found[lo:hi].argmax(axis=0) + lo for lo, hi in zip(starts, ends, strict=True)])
        np.put_along_axis(back, best, np.take_along_axis(back, best, 0) + slope * self.p["most"], 0)
        back *= found + self.p["bias"] > 0
        tables = np.zeros(TAPS * SYMBOLS * FILTERS)
        for t in range(TAPS):
            index = (t * SYMBOLS + symbols[place * STRIDE + t].astype(np.int64)) * FILTERS + np.arange(FILTERS)
            tables += np.bincount(index.ravel(), back.ravel(), tables.size)
        decay = 1e-5
        return {
            "tables": tables.reshape(self.p["tables"].shape) + decay * self.p["tables"],
            "bias": back.sum(axis=0),
            "most": (slope * most).sum(axis=0) + decay * self.p["most"],
            "mean": (slope * mean).sum(axis=0) + decay * self.p["mean"],
            "base": slope.sum(keepdims=True)[0],
        }


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """A scoring function over lists of encoded texts, learned from the bounded sample."""
    classes, share = labelled_ids(docs, labels, label, per_class, FOLDS, HELD_OUT)
    y = sorted(classes.items())
    ones = sum(v for _, v in y)
    if ones in (0, len(y)):
        same = (ones + 1) / (len(y) + 2)
        return lambda texts: np.full(len(texts), same)

    rows = sorted({(r.doc_id, r.text or "") for r in sampled_texts(docs, classes).collect()})
    return Network().fit([t.encode() for _, t in rows], np.array([classes[i] for i, _ in rows], float), share).score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    score = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 1 << 20):
            found = score([t.encode() for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with their columns, whose text scores at least the threshold."""
    score = fit(docs, labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 1 << 20):
            found = score([t.encode() for t in texts_of(batch)])
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, schema)


def op6_quality_cnn(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
