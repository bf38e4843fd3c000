"""Media columns kept as content-defined chunks.

A payload is bytes. Here it is a text's UTF-8 with bytes 0 appended up to a positive multiple of PAD.
It is stored losslessly, byte for byte, as a list of chunks:

* Cuts follow content: a rolling gear hash (each step shifts the hash by one bit and adds a random
  value of the byte, so that it depends on the last 32 bytes) ends a chunk where its top MASK_BITS bits
  are 0, from LEAST bytes on, and at MOST bytes at the latest. Equal stretches of different payloads get
  equal chunks whatever precedes them.
* A chunk is named by its SHA-256 digest. Which digests occur more than once, Spark counts over all chunk
  lists; they go into a membership filter, sized by their number up to 2^MOST_BITS bits, whose false positives
  only cost work.
* The store is two tables in the shared folder. A row of `lists` is a block of documents: each one's media file
  head, which is the ordered list of digests and sizes, and, compressed together, the bytes of the chunks that
  the filter doesn't name. Documents that lack chunks and those that don't have rows of their own. A row of
  `chunks` is a digest that the filter names, with its bytes, once: occurrences are deduplicated by digest,
  within each task first, and what is asked for is asked once a block.
* Reading back joins the digests that a block of documents misses with `chunks`, by digest and a salt for those
  that very many blocks have, and puts each document's media file together: the head, then its distinct chunks
  in order of first use. The payload is decoded from that file, every chunk against its digest.

The stored form is that file. Its digest and size are taken from what was read back, as are the payload's and
its features; they depend on the payload alone.

Texts are read twice, once for the counts and once to be stored. Bytes of chunks that only one payload has are
written and read in place, without an exchange.

Defined cases: a null text counts as empty, whose payload is PAD bytes 0; rows are documents, whatever their
ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import mix64, sized_batches, spill_table, texts_of

PAD = 64
#: Chunk sizes in bytes: least and most, and the bits that give 2^MASK_BITS bytes on average beyond the least.
LEAST, MOST, MASK_BITS = 512, 16_384, 11
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of text in a block of documents.
BLOCK = 8 << 20
#: Bits of the filter for each digest that it names, and the logarithms of its least and largest size.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 30
#: Blocks that get a chunk from one copy of it; where more have it, it is sent in several.
FREQUENT = 256


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(PAD - len(data) % PAD if len(data) % PAD or not data else 0)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the last 32 bytes, each shifted by its distance.

    The rolling hash in five doublings: of windows of 1, 2, 4, 8, 16 and 32 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h[width:] += shifted
    return h


def cuts(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of bytes begin..end; marks: sorted places after which the hash allows a cut."""
    out, at = [], begin
    while end - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        cut = min(int(marks[i]) if i < len(marks) else end, at + MOST, end)
        if cut >= end:
            break
        out.append(cut)
        at = cut
    return [*out, end]


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload, from one pass over all. A cut looks back 32 bytes, and none is allowed
    in a payload's first LEAST, so the bytes of the payload before play no part."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    if not data.size:
        return [[] for _ in payloads]
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    for p in payloads:
        lo, hi = np.searchsorted(marks, [at, at + len(p)])
        out.append([e - at for e in cuts(marks[lo:hi], at, at + len(p))])
        at += len(p)
    return out


def split(data: bytes, ends: list[int]) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


HEAD = ">4sI"


def media_head(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """What begins a media file: mark, count, then digest and length of each chunk in order."""
    return struct.pack(HEAD, b"CDC1", len(chunks)) + b"".join(d + struct.pack(">I", len(c)) for d, c in zip(digests, chunks, strict=True))


def read_head(head: bytes) -> list[tuple[bytes, int]]:
    mark, count = struct.unpack_from(HEAD, head)
    if mark != b"CDC1":
        raise ValueError("not a media file")
    at = struct.calcsize(HEAD)
    return [(head[i : i + 32], struct.unpack_from(">I", head, i + 32)[0]) for i in range(at, at + 36 * count, 36)]


def media_file(head: bytes, chunks: dict[bytes, bytes]) -> bytes:
    """The stored form: its head, then each distinct chunk once, in order of first use."""
    return head + b"".join(chunks[d] for d in dict.fromkeys(d for d, _ in read_head(head)))


def decode(media: bytes) -> bytes:
    """The payload of a media file, each chunk checked against its digest."""
    listed = read_head(media)
    at, found = struct.calcsize(HEAD) + 36 * len(listed), {}
    for digest, size in dict(listed).items():
        found[digest] = media[at : at + size]
        at += size
        if hashlib.sha256(found[digest]).digest() != digest:
            raise ValueError("a stored chunk doesn't match its digest")
    if at != len(media):
        raise ValueError("a media file has bytes beyond its chunks")
    return b"".join(found[d] for d, _ in listed)


def feature(data: bytes) -> str:
    """A coarse picture of the samples: sixteen means of equal stretches, two hex digits each."""
    samples = np.frombuffer(data, dtype=np.uint8)
    return bytes(int(part.sum()) // part.size for part in np.array_split(samples, 16)).hex()


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[list[bytes]], list[list[bytes]]]]:
    """Blocks of documents: the rows, their texts, chunks and digests."""
    for batch in sized_batches(batches, "text", BLOCK):
        texts = texts_of(batch)
        payloads = [payload(t) for t in texts]
        chunks = [split(p, e) for p, e in zip(payloads, chunk_ends(payloads), strict=True)]
        yield batch, texts, chunks, [[hashlib.sha256(c).digest() for c in each] for each in chunks]


def name_of(digest: bytes) -> int:
    """The digest's first 60 bits, by which chunks are counted and looked up in the filter."""
    return int.from_bytes(digest[:8], "big") >> 4


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, digests in _split_batches(batches):
        # a payload's own repetitions don't make a chunk common
        flat = [name_of(d) for each in digests for d in dict.fromkeys(each)]
        yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64())], ["name"])


def common_chunks(docs: DataFrame) -> DataFrame:
    """(name, uses): the chunks that more than one document has. Counted map-side before the exchange."""
    return docs.select("text").mapInArrow(_names, "name bigint").groupBy("name").agg(F.count("*").alias("uses")).where("uses > 1")


class Filter:
    """Membership of digests by the first bits of their names: a table of 2^bits bits."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def __contains__(self, digest: bytes) -> bool:
        at = name_of(digest) >> (60 - self.bits)
        return bool(self.table[at >> 3] >> (at & 7) & 1)


def filter_of(common: DataFrame) -> Broadcast:
    """The filter that names the chunks, broadcast: 2^MOST_BITS bits at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * common.count()).bit_length()))
    at = F.shiftright("name", 60 - bits) + 1  # the bitmap functions count from 1
    rows = common.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows.collect():
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return common.sparkSession.sparkContext.broadcast(Filter(bits, table))


_STORED = "block string, lacking boolean, doc_ids array<bigint>, n_bytes array<bigint>, heads array<binary>, own_sizes array<bigint>, own binary, digest binary, data binary"
_KINDS = (pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
_NAMES = [c.split(" ")[0] for c in _STORED.split(", ")]
_LIST = _NAMES[:7]


def stored_rows(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows of blocks of documents, and rows (block, digest, data) of the chunks that the filter names, of which
    each task gives the data once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, press, given = shared.value, zstandard.ZstdCompressor(level=3), set()
        for nth, (batch, texts, chunks, digests) in enumerate(_split_batches(batches)):
            block, common, sides = f"{TaskContext.get().partitionId()}-{nth}", {}, {False: [], True: []}
            for doc_id, text, each, named in zip(batch.column("doc_id").to_pylist(), texts, chunks, digests, strict=True):
                once = dict(zip(named, each, strict=True))
                lent = {d: c for d, c in once.items() if d in names}
                common |= lent
                own = b"".join(c for d, c in once.items() if d not in lent)
                sides[bool(lent)].append((doc_id, len(text.encode()), media_head(each, named), len(own), own))
            rows: list[tuple] = []
            for lacking, side in sides.items():
                if side:
                    ids, sizes, heads, own_sizes, own = map(list, zip(*side, strict=True))
                    rows.append((block, lacking, ids, sizes, heads, own_sizes, press.compress(b"".join(own)), None, None))
            rows += [(block, *[None] * 6, d, None if d in given else press.compress(c)) for d, c in common.items()]
            given |= common.keys()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORED)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the store: `lists`, `chunks`, and which chunks each block lacks (block, digest)."""
    shared = filter_of(spill_table(common_chunks(docs), "common"))
    # in buckets of blocks: what blocks lack comes to them, and they stay where they are
    rows = spill_table(stored_rows(docs, shared), "media", by="block")
    needs = rows.where("digest IS NOT NULL").select("block", "digest")
    return rows.where("digest IS NULL").select(*_LIST), spill_table(once_each(rows), "chunks"), needs


def once_each(rows: DataFrame) -> DataFrame:
    """(digest, data, blocks) of stored rows: each chunk once, and how many blocks lack it."""
    blocks = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("blocks"))
    data = rows.where("data IS NOT NULL").select("digest", "data").dropDuplicates(["digest"])
    return data.join(blocks, "digest")


def _read(row: dict, common: dict[bytes, bytes]) -> pa.RecordBatch:
    """What is returned, from a stored block of documents and the chunks they lack."""
    out, from_ = [], 0
    every = zstandard.ZstdDecompressor().decompress(row["own"])
    for doc_id, n, head, size in zip(row["doc_ids"], row["n_bytes"], row["heads"], row["own_sizes"], strict=True):
        mine, from_ = every[from_ : from_ + size], from_ + size
        listed, at, chunks = dict(read_head(head)), 0, {}
        for digest, length in listed.items():
            if digest in common:
                chunks[digest] = common[digest]
            else:
                chunks[digest] = mine[at : at + length]
                at += length
        media = media_file(head, chunks)
        try:
            data = decode(media)
        except ValueError as e:
            raise ValueError(f"document {doc_id}: {e}") from e
        out.append(
            {
                "doc_id": doc_id,
                "n_bytes": n,
                "payload_bytes": len(data),
                "payload_sha256": hashlib.sha256(data).hexdigest(),
                "tail_crc32": zlib.crc32(data[-64:]),
                "media_bytes": len(media),
                "media_sha256": hashlib.sha256(media).hexdigest(),
                "feature": feature(data),
                "n_chunks": len(read_head(head)),
                "n_shared": sum(d in common for d in listed),
            }
        )
    return pa.RecordBatch.from_pylist(out, schema=_OUT)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32()), ("n_shared", pa.int32())]
)
_OUT_DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int, n_shared int"


def read_back(lists: DataFrame, chunks: DataFrame, needs: DataFrame) -> DataFrame:
    """Digests and features of the payloads, put together from the store alone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _read(batch.slice(i, 1).to_pylist()[0], {})

    def joined(rows: pa.Table, found: pa.Table) -> pa.Table:
        read = zstandard.ZstdDecompressor()
        common = {d: read.decompress(c) for d, c in zip(found.column("digest").to_pylist(), found.column("data").to_pylist(), strict=True)}
        return pa.Table.from_batches([_read(r, common) for r in rows.to_pylist()], schema=_OUT)

    alone = lists.where("NOT lacking").mapInArrow(whole, _OUT_DDL)
    # what many blocks lack is asked for under several salts; how many is the chunk's to say
    salts = F.ceil(F.col("blocks") / FREQUENT)
    frequent = chunks.where(F.col("blocks") > FREQUENT).select("digest", salts.alias("salts"))
    asked = needs.join(frequent, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("block"), F.coalesce("salts", F.lit(1)))).select("block", "digest", "salt")
    sent = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("digest", "salt", "data")
    found = asked.join(sent, ["digest", "salt"]).select(F.col("block").alias("of_block"), "digest", "data")
    # a block holds BLOCK bytes of documents, so no group is larger than that or one document
    some = lists.where("lacking").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(joined, _OUT_DDL)
    return alone.unionByName(some)


def media_of(docs: DataFrame) -> DataFrame:
    """Stores every document's payload as chunks and reads it back."""
    return read_back(*store(docs))


def op2_media_chunks(spark, sf_dir: str) -> DataFrame:
    return media_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
