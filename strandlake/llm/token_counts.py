"""Token counts per document without token ids.

A byte-level BPE cuts a text into pre-tokens and encodes each alone, so a document's count is the sum,
over its distinct pre-tokens, of frequency times pieces. Pieces are counted once per distinct
pre-token, by the library, and joined to the documents' frequencies:

1. Documents are read in blocks of about BLOCK bytes. A block row holds its documents' frequencies over
   the block's own sorted list of distinct pre-tokens, and that list in hash buckets. Block rows are
   written once, compressed, to the shared folder, so that nothing is cut twice and a lost executor
   costs no more than its tasks.
2. The lists meet by bucket, sorted; a task counts each distinct pre-token of a bucket once and answers
   every block's list with one piece count per entry.
3. Answers, grouped by block, join the block rows, and the documents' sums are formed.

What is shuffled is lists of distinct pre-tokens and of small integers, never texts or ids; a frequent
pre-token occurs once per block, however many documents have it. A worker keeps at most KEPT counts of a
bucket at a time; beyond that, some are counted again.

Special strings of the tokenizer within a text count as one token each, as is its default.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; repeated rows and ids stay separate rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe_tree import PATTERN, engine_pattern
from strandlake.llm.common import sized_batches, spill_table, texts_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BLOCK = 8 << 20
BUCKETS = 256
KEPT = 1_000_000
LIMIT = 1024

#: The pattern over ASCII texts, for the faster engine.
_ASCII = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+"), re.ASCII)
_ANY = regex.compile(engine_pattern(PATTERN))


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """The tokenizer's special strings; refuses tokenizers whose pre-tokens don't add up to the text's tokens."""
    with open(path) as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        raise ValueError(f"{path}: only byte-level tokenizers without normaliser or prefix space are counted by pre-token")
    return tuple(t["content"] for t in spec["added_tokens"])


def pre_tokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(words: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in _library(path).encode_batch(words, add_special_tokens=False)] if words else []


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed value: bytes of equal weight stand together."""
    head = np.array([a.size for a in arrays], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(data: bytes, arrays: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out, at = [], 8 * arrays
    for n in raw[:at].view(np.int64):
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(np.int64).ravel())
        at += 8 * int(n)
    return out


def pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *map(len, data)], dtype=np.uint32).tobytes() + b"".join(data))


def unpack_words(packed: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.r_[4 + 4 * n, ends[:-1]]
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def block_row(ids: list[int | None], texts: list[str], specials: tuple[str, ...], buckets: int) -> tuple[bytes, list[dict]]:
    """A block's packed frequencies and its distinct pre-tokens, packed by bucket."""
    cut = re.compile("|".join(map(re.escape, specials))) if specials else None
    number: dict[str, int] = {}
    index, freq, rows, special, size = [], [], [], [], []
    for text in texts:
        parts = cut.split(text) if cut and any(s in text for s in specials) else [text]
        seen = Counter(pre_tokens(parts[0]))
        for part in parts[1:]:
            seen.update(pre_tokens(part))
        index += [number.setdefault(w, len(number)) for w in seen]
        freq += seen.values()
        rows.append(len(seen))
        special.append(len(parts) - 1)
        size.append(len(text.encode()))
    words = np.array(list(number), dtype=object)
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in number], dtype=np.int64)
    order = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])), dtype=np.int64)
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    owner = np.repeat(np.arange(len(rows)), rows)
    at = place[np.array(index, dtype=np.int64)] if index else np.empty(0, np.int64)
    by = np.lexsort((at, owner))
    at, owner = at[by], owner[by]
    step = np.diff(at, prepend=0)  # small within a document
    known = np.array([i is not None for i in ids], dtype=np.int64)
    data = pack(np.array([i or 0 for i in ids], np.int64), known, np.array(size), np.array(special), np.array(rows), step, np.array(freq, np.int64)[by])
    lists, sorted_bucket = [], bucket[order]
    for b in np.unique(sorted_bucket):
        lo, hi = np.searchsorted(sorted_bucket, [b, b + 1])
        lists.append({"bucket": int(b), "words": pack_words(words[order[lo:hi]].tolist())})
    return data, lists


def count_tokens(docs: DataFrame, path: str = TOKENIZER, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs."""
    spark = docs.sparkSession
    specials = special_strings(path)
    buckets = max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, kinds = 0, pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))
        for batch in sized_batches(batches, "text", block):
            ids = batch.column("doc_id").to_pylist()
            data, lists = block_row(ids, texts_of(batch), specials, buckets)
            name = f"{TaskContext.get().partitionId()}-{nth}"
            nth += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([lists], kinds)], ["block", "data", "lists"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in batches:
            names, numbers, out = batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), []
            for number, packed in zip(numbers, batch.column("words").to_pylist(), strict=True):
                if number != current or len(known) > KEPT:
                    current, known = number, {}
                words = unpack_words(packed)
                new = [w for w in words if w not in known]
                known.update(zip(new, pieces(new, path), strict=True))
                out.append(pack(np.array([known[w] for w in words], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "counts"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ids, known, size, special, rows, step, freq = unpack(data, 7)
                found = sorted(found or [], key=lambda x: x["bucket"])
                count = np.concatenate([unpack(x["counts"], 1)[0] for x in found]) if found else np.empty(0, np.int64)
                owner = np.repeat(np.arange(ids.size), rows)
                total = np.bincount(owner, freq * count[np.cumsum(step)], minlength=ids.size).astype(np.int64) if step.size else np.zeros(ids.size, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=known == 0), pa.array(size), pa.array(total + special)], ["doc_id", "n_bytes", "n_tokens"]
                )

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = spill_table(cut.mapInArrow(blocks, "block string, data binary, lists array<struct<bucket int, words binary>>"), "pretokens")
    asked = rows.select("block", F.explode("lists").alias("list")).select("block", "list.bucket", "list.words")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answers, "block string, bucket int, counts binary")
    by_block = answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("found"))
    counted = rows.select("block", "data").join(by_block, "block", "left").select("data", "found").mapInArrow(sums, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
