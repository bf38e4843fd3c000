"""Cuts equal a byte-by-byte gear hash; payloads come back whole; shared chunks are stored once."""

import hashlib
import random
import zlib

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import media_chunks as m


def rolling_cuts(data: bytes) -> list[int]:
    out, start = [], 0
    h = 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(m.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        if i + 1 < len(data) and (size >= m.LEAST and h >> (32 - m.MASK_BITS) == 0 or size == m.MOST):
            out.append(i + 1)
            start = i + 1
    return [*out, len(data)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32), st.integers(0, 60_000)), min_size=1, max_size=4))
def test_cuts_equal_a_rolling_hash(seeds):
    payloads = [m.payload("") if n == 0 else np.random.default_rng(s).integers(0, 256, n, dtype=np.uint8).tobytes() for s, n in seeds]
    assert m.chunk_ends(payloads) == [rolling_cuts(p) for p in payloads]


def test_largest_chunk():
    data = b"\0" * (3 * m.MOST + 5)
    assert m.chunk_ends([data])[0] == rolling_cuts(data)


def test_store_and_read_back(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdefgh é\n") for _ in range(n))
    shared = text(30_000)
    texts = [None, "", "x" * 63, "x" * 64, "é" * 33, shared, shared, text(200) + shared, shared[:9000] + text(500) + shared[9000:], text(200_000), shared[:4000] * 3]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(5, "other text, same id", "k", 1), (6, shared, "k", 1), (None, "no id", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_bytes int").repartition(3)
    out = m.media_of(docs).collect()
    assert len(out) == len(rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out)
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((str(i), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert got == sorted(want)
    by_text = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.n_shared for r in out) > 20, "copies share their chunks"
    assert m.media_of(docs.limit(0)).count() == 0


def _store(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    shared = text(40_000)
    rows = [(i, text(300) + shared) for i in range(30)] + [(100 + i, text(5000)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return rows, docs, m.store(docs)


def test_chunks_of_several_documents_are_stored_once(spark):
    rows, docs, (lists, chunks, needs) = _store(spark)
    payloads = [m.payload(t) for _, t in rows]
    uses = {}
    for p in payloads:
        for c in set(m.split(p, rolling_cuts(p))):
            uses[c] = uses.get(c, 0) + 1
    stored = chunks.collect()
    read = zstandard.ZstdDecompressor().decompress
    assert {read(r.data) for r in stored} == {c for c, n in uses.items() if n > 1} and len({r.digest for r in stored}) == len(stored)
    kept = sum(len(read(r.own)) for r in lists.collect()) + sum(len(read(r.data)) for r in stored)
    assert kept == sum(map(len, uses)) < 0.2 * sum(map(len, payloads))
    out = {r.doc_id: r for r in m.read_back(lists, chunks, needs).collect()}
    for (i, _), p in zip(rows, payloads, strict=True):
        chunk = m.split(p, rolling_cuts(p))
        digests = [hashlib.sha256(c).digest() for c in chunk]
        media = m.media_file(m.media_head(chunk, digests), dict(zip(digests, chunk, strict=True)))
        assert m.decode(media) == p and (out[i].media_bytes, out[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_a_chunk_of_very_many_blocks_is_sent_in_copies(spark, monkeypatch):
    monkeypatch.setattr(m, "FREQUENT", 1)  # blocks are the four partitions
    rows, docs, parts = _store(spark)
    out = {r.doc_id: r.payload_sha256 for r in m.read_back(*parts).collect()}
    assert out == {i: hashlib.sha256(m.payload(t)).hexdigest() for i, t in rows}


def test_a_filter_that_names_everything_changes_nothing(spark, monkeypatch):
    rows, docs, parts = _store(spark)
    want = sorted(tuple(r)[:8] for r in m.read_back(*parts).collect())
    monkeypatch.setattr(m.Filter, "__contains__", lambda self, digest: True)
    shared = spark.sparkContext.broadcast(m.Filter(20, np.full((1 << 20) // 8, 255, np.uint8)))
    stored = m.stored_rows(docs, shared)
    lists, needs = stored.where("digest IS NULL").select(*m._LIST), stored.where("digest IS NOT NULL").select("block", "digest")
    got = m.read_back(lists, m.once_each(stored), needs).collect()
    assert sorted(tuple(r)[:8] for r in got) == want and all(r.n_shared for r in got)


def test_damage_is_noticed(spark):
    rows, docs, (lists, chunks, needs) = _store(spark)
    press, read = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor().decompress
    spoil = lambda data: press.compress(b"#" + read(data)[1:])
    changed = lambda df, c: spark.createDataFrame([r.asDict() | {c: bytearray(spoil(r[c]))} if len(read(r[c])) else r.asDict() for r in df.collect()], df.schema)
    for damaged in ((lists, changed(chunks, "data"), needs), (changed(lists, "own"), chunks, needs), (lists, chunks.orderBy("digest").limit(1), needs)):
        try:
            m.read_back(*damaged).collect()
        except Exception as e:
            assert "doesn't match its digest" in str(e) or "beyond its chunks" in str(e)
        else:
            raise AssertionError("not noticed")
