"""Byte-level BPE as a monoid: encode halves, join neighbours, decode by concatenation.

A segment of text is a monoid element; its value is the segment's token list. The recursion ends at
segments of LEAF characters, a few tokens each, which the library encodes; every longer text goes through
the tree, and how often it was joined is returned with it. Two neighbours are joined by re-encoding a
window around their border. The window grows until both of its ends are provably stable:

* in text, where something other than white space is followed by white space. No alternative of the
  splitting pattern matches across such a place and none looks behind, so the matches on either side
  of it are the same whatever text is added on the other;
* within one long match (no such place near), the window grows token by token over the match's
  bytes, until its outermost tokens are compatible with their neighbours outside. A sequence of
  tokens is the encoding of a match if and only if each adjacent pair encodes to itself.

So a text of any length, also one without any white space, is encoded in small steps, and the result
is the library's whatever the sizes of the leaves are: both rules hold at any border. Decoding
concatenates the bytes of halves up the same kind of tree.

Defined cases: a null text counts as empty; an empty text has no tokens, and its digests are those of
no bytes; repeated rows give repeated results; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from strandlake.llm.common import sized_batches, texts_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Where the recursion ends: characters of a text, bytes of one match, tokens to decode.
LEAF = 64
LEAF_BYTES = 16
LEAF_TOKENS = 64

#: White space as the patterns' engines have it (Unicode White_Space), which Python's \s is not.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space: each begins at a stable place.
_RUN = re.compile(f"[{WHITE}]+")


def engine_pattern(pattern: str) -> str:
    """The splitting pattern with white space spelled out."""
    return pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")


class TreeBpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks_path: str = RANKS, pattern: str = PATTERN, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(engine_pattern(pattern))
        self.size = {i: len(token) for token, i in ranks.items()}
        self.leaf, self.leaf_bytes = leaf, leaf_bytes
        self.joins = 0

    # text level

    def encode(self, text: str) -> list[int]:
        """The text's tokens; `joins` then says how many joins of halves they took."""
        self.joins = 0
        return self.encode_part(text, [m.start() for m in _RUN.finditer(text)], 0, len(text))

    def encode_part(self, text: str, stable: list[int], begin: int, end: int) -> list[int]:
        """Tokens of text[begin:end] encoded alone; stable: the text's stable places, in order."""
        if end - begin <= self.leaf:
            return self.bpe.encode_ordinary(text[begin:end])
        mid = (begin + end) // 2
        left, right = self.encode_part(text, stable, begin, mid), self.encode_part(text, stable, mid, end)
        return self.join(text, stable, begin, mid, end, left, right)

    def join(self, text: str, stable: list[int], begin: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[begin:end], given those of its halves, each encoded alone."""
        self.joins += 1
        at = bisect.bisect_left(stable, mid)
        if at < len(stable) and stable[at] == mid:
            left += right
            return left
        lo = max(begin, stable[at - 1]) if at else begin
        hi = min(end, stable[at]) if at < len(stable) else end
        # the tokens that the window covers on either side
        stale, drop = len(text[lo:mid].encode()), len(left)
        while stale > 0:
            drop -= 1
            stale -= self.size[left[drop]]
        stale, take = len(text[mid:hi].encode()), 0
        while stale > 0:
            stale -= self.size[right[take]]
            take += 1
        left[drop:] = self.encode_window(text[lo:hi])
        left += right[take:] if take else right
        return left

    def encode_window(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for match in self.split.finditer(text):
            out += self.encode_match(match.group().encode())
        return out

    # byte level, inside one match

    def direct(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)

    def encode_match(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.direct(data)
        mid = len(data) // 2
        self.joins += 1
        return self.join_match(self.encode_match(data[:mid]), self.encode_match(data[mid:]))

    def compatible(self, a: int, b: int) -> bool:
        both = self.bpe.decode_single_token_bytes(a) + self.bpe.decode_single_token_bytes(b)
        return self.direct(both) == [a, b]

    def join_match(self, left: list[int], right: list[int]) -> list[int]:
        near_left = near_right = 1
        while True:
            near_left, near_right = min(near_left, len(left)), min(near_right, len(right))
            window = left[len(left) - near_left :] + right[:near_right]
            fresh = self.direct(self.bpe.decode_bytes(window))
            left_done = near_left == len(left) or self.compatible(left[-near_left - 1], fresh[0])
            right_done = near_right == len(right) or self.compatible(fresh[-1], right[near_right])
            if left_done and right_done:
                return left[: len(left) - near_left] + fresh + right[near_right:]
            near_left *= 1 if left_done else 2
            near_right *= 1 if right_done else 2

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.bpe.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def coder(ranks_path: str = RANKS, pattern: str = PATTERN) -> TreeBpe:
    return TreeBpe(ranks_path, pattern)


def encode_column(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(ranks_path, pattern)
        for batch in sized_batches(batches, "text"):
            ids = pa.array([tree.encode(t) for t in texts_of(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Per document the token count, the digests of its ids and of the bytes they decode to, and the joins it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(ranks_path, pattern)
        for batch in sized_batches(batches, "text"):
            counts, of_ids, of_bytes, joins = [], [], [], []
            for text in texts_of(batch):
                ids = tree.encode(text)
                joins.append(tree.joins)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(joins, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"],
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_joins bigint"
    )


def op8_bpe_tree(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
