"""Shared plumbing: table access, scratch tables on shared storage, and text kernels in numpy."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets: the fold that decides what is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        shared_dir.own = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Small intermediate result, computed now and kept in the shared folder: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[tuple[SparkSession, str]] = []


def spill_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Large intermediate result, written as compressed Parquet to the shared folder and read back.

    by: a column by whose hash the rows are written in buckets, so that reading them by it needs no exchange."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex}"
    written = df.write.option("compression", "zstd")
    _scratch.append((spark, path))
    if by is None:
        written.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    written.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table_name)
    return spark.table(table_name)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that are written inside are deleted at the end: what is returned must be cut by then."""
    before = len(_scratch)
    try:
        yield
    finally:
        for spark, path in _scratch[before:]:
            _delete(spark, path)
        del _scratch[before:]


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def arrow_udf_over(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """mapInArrow over only the named columns, so that nothing else crosses to Python."""
    return df.select(*columns).mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of the column: bounds the kernels' memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps on overflow by design."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    if _powers.kept.size < n:
        _powers.kept = np.cumprod(np.full(max(n, 4096), 0xD6E8FEB86659FD93, dtype=np.uint64))
    return _powers.kept


_powers.kept = np.empty(0, dtype=np.uint64)


def words_in(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text, found and hashed in one vectorised pass.

    Returns (bytes of all texts, each followed by a space; start and end of each word in them;
    64-bit hash of each word; index of each word's text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    space = _IS_SPACE[data]
    # positions where the class changes: word starts and ends alternate
    edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if starts.size == 0:
        none = np.empty(0, dtype=np.int64)
        return data, none, none, np.empty(0, dtype=np.uint64), none
    inside = np.flatnonzero(~space)
    size = ends - starts
    first = np.cumsum(size) - size  # of each word among the bytes inside words
    place = np.arange(inside.size) - np.repeat(first, size)
    values = _BYTE_VALUE[data[inside]] * _powers(int(size.max()))[place]
    hashes = mix64(np.add.reduceat(values, first) + size.astype(np.uint64))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return data, starts, ends, hashes, owner


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes.

    Returns (bounds, hashes): text i owns hashes[bounds[i]:bounds[i+1]]. A text with fewer than k
    words has its whole word sequence as one shingle; one without words has none."""
    _, _, _, h, owner = words_in(texts)
    n = len(texts)
    count = np.bincount(owner, minlength=n) if owner.size else np.zeros(n, dtype=np.int64)
    first = np.cumsum(count) - count
    long_enough = count >= k
    if h.size >= k:
        total = np.zeros(h.size - k + 1, dtype=np.uint64)
        for j in range(k):
            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[j : h.size - k + 1 + j])
        whole = owner[: h.size - k + 1] == owner[k - 1 :]
        doc, value = owner[: h.size - k + 1][whole], total[whole]
    else:
        doc, value = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    short = np.flatnonzero(~long_enough & (count > 0))
    extra = np.empty(short.size, dtype=np.uint64)
    for at, i in enumerate(short):
        total = np.full(1, count[i], dtype=np.uint64)
        for j in range(first[i], first[i] + count[i]):
            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
        extra[at] = total[0]
    doc, value = np.r_[doc, short].astype(np.int64), np.r_[value, extra]
    order = np.argsort(doc, kind="stable") if short.size else None
    if order is not None:
        doc, value = doc[order], value[order]
    bounds = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=n), out=bounds[1:])
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    for i in range(n):
        part = np.unique(value[bounds[i] : bounds[i + 1]])
        sizes[i] = part.size
        parts.append(part)
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out, np.concatenate(parts) if parts else value
