"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own centroids, learned by k-means on a
bounded sample (at most SAMPLE rows, first by a hash of their ids). Their number grows with the fourth root of
the rows, so that cells, the pairs of centroids, grow with the square root. Every row is indexed in its cell.
A query's cells are visited in order of the two halves' summed distance (minus the inner product with the
centroid), by a heap over pairs of the two sorted lists, until the cells hold the share of all rows that gave
TARGET recall on the sample. What they hold is scored exactly, in double precision, against the original
vectors, and the nearest `k` stay, ties to the smaller id.

Cells are packed into blocks in cell order; a cell with more rows than a block is split by hash. A query goes
to the blocks that hold a cell it visits, with that block's share of its cells. A task holds one block and lets
its queries stream by, so memory is bounded however full a cell is. A block's rows are shuffled once for every
QUERIES queries that visit it, and at least that often if any does; so up to that many queries the exchange of
entries is linear in the rows. The number of pairs scored is the queries times the share times the rows.

Defined cases: vectors that are null, zero, or hold nulls or values that are not finite take no part, nor do
those of another length than most (ties: the shortest), with which no inner product is defined, nor rows
without an id; rows with equal ids are separate candidates and queries; a query is never its own candidate;
with fewer candidates than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import spill_table

SAMPLE, TARGET, TRIALS = 20_000, 0.95, 256
#: Centroids of a half: this times the fourth root of the rows, and at most so many that SAMPLE can tell them apart.
CENTROIDS, MOST_CENTROIDS = 6.0, SAMPLE // 16
#: Rows of a block, least and most; queries of a block that meet in one task.
LEAST_BLOCK, MOST_BLOCK, QUERIES = 1024, 16_384, 65_536
K = 20


def centroids_for(rows: int) -> int:
    return max(2, min(MOST_CENTROIDS, round(CENTROIDS * rows**0.25)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)"
    )
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("v") == (length.n if length else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


class Quantiser:
    def __init__(self, sample: np.ndarray, centroids: int, k: int = K, target: float = TARGET):
        self.half = max(1, sample.shape[1] // 2)
        self.first, self.second = kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :], centroids)
        self.cells = len(self.first) * len(self.second)
        self.share = self._share_for(sample, k, target)

    def cell(self, v: np.ndarray) -> np.ndarray:
        return nearest(v[:, : self.half], self.first) * len(self.second) + nearest(v[:, self.half :], self.second)

    def visit(self, q: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
        """Cells in order of summed distance until they hold `enough` rows."""
        near_first, near_second = -(self.first @ q[: self.half]), -(self.second @ q[self.half :])
        i_order, j_order = np.argsort(near_first, kind="stable").tolist(), np.argsort(near_second, kind="stable").tolist()
        di, dj = near_first[i_order].tolist(), near_second[j_order].tolist()
        heap, out, held, width = [(di[0] + dj[0], 0, 0)], [], 0, len(self.second)
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * width + j_order[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            # each pair is pushed once: the next in a row by its left neighbour, a row by the one above
            if j + 1 < len(dj):
                heapq.heappush(heap, (di[i] + dj[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(di):
                heapq.heappush(heap, (di[i + 1] + dj[0], i + 1, 0))
        return out

    def _share_for(self, sample: np.ndarray, k: int, target: float) -> float:
        """The least share of rows, in visiting order, that holds `target` of the sample's own nearest."""
        trials = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
        cells = self.cell(sample)
        counts = np.bincount(cells, minlength=self.cells)
        shares = []
        for q in trials:
            scores = sample @ q
            top = np.argpartition(-scores, min(k, len(scores) - 1))[: k + 1]
            order = self.visit(q, counts, np.inf)
            upto = np.zeros(self.cells)
            upto[order] = np.cumsum(counts[order]) / len(sample)
            shares += upto[cells[top]].tolist()
        return float(np.quantile(shares, target))


def fit(rows: DataFrame, k: int = K) -> Quantiser | None:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    if not sample:
        return None
    total = rows.count() if len(sample) == SAMPLE else len(sample)
    return Quantiser(np.array([r.v for r in sample]), centroids_for(total), k)


class Blocks:
    """Cells in blocks, in cell order. Small cells share one; large ones have several, by hash of the row."""

    def __init__(self, counts: np.ndarray, size: int):
        self.parts = np.maximum(1, -(-counts // size))
        self.first = np.zeros(counts.size, dtype=np.int64)
        block, held = 0, 0
        for c, (n, parts) in enumerate(zip(counts.tolist(), self.parts.tolist(), strict=True)):
            if parts > 1 or held + n > size:
                block, held = block + (held > 0), 0
            self.first[c] = block
            if parts > 1:
                block += parts
            else:
                held += n
        self.last = self.first + self.parts - 1
        self.number = int(self.last.max()) + 1
        # the range of a block's cells; a split cell has its blocks to itself
        cells = np.arange(counts.size)
        self.lows, self.highs = np.full(self.number, counts.size), np.zeros(self.number, dtype=np.int64)
        np.minimum.at(self.lows, self.first, cells)
        np.maximum.at(self.highs, self.first, cells + 1)
        for c in np.flatnonzero(self.parts > 1):
            self.lows[self.first[c] : self.last[c] + 1], self.highs[self.first[c] : self.last[c] + 1] = c, c + 1

    def of_rows(self, cells: np.ndarray, rids: np.ndarray) -> np.ndarray:
        return self.first[cells] + rids % self.parts[cells]

    def of_visit(self, cells: list[int]) -> list[tuple[int, bytes]]:
        """The blocks that hold any of the cells, each with its own cells as bits."""
        at = np.array(cells, dtype=np.int64)
        mask = np.zeros(self.first.size, dtype=bool)
        mask[at] = True
        split = at[self.parts[at] > 1]
        blocks = np.unique(np.concatenate([self.first[at], *(np.arange(self.first[c], self.last[c] + 1) for c in split)]))
        return [(int(b), np.packbits(mask[self.lows[b] : self.highs[b]]).tobytes()) for b in blocks]


def top_scores(queries: np.ndarray, entries: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best allowed entries. The matrix product finds them
    with room for its rounding; they are then scored row by row, so equal vectors get equal scores."""
    out = []
    for lo in range(0, len(queries), 256):
        rough = np.where(allowed[lo : lo + 256], queries[lo : lo + 256] @ entries.T, -np.inf)
        for q, row in zip(queries[lo : lo + 256], rough, strict=True):
            best = np.flatnonzero(row > -np.inf)
            if best.size > k:
                least = np.partition(row, row.size - k)[row.size - k]
                best = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))
            exact = np.einsum("ij,j->i", entries[best], q)
            order = np.lexsort((ids[best], -exact))[:k]
            out.append((best[order], exact[order]))
    return out


def search(vectors: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row that fulfils is_query (on vec_id)."""
    spark = vectors.sparkSession
    out_type = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    quantiser = fit(rows, k)
    if quantiser is None:
        return spark.createDataFrame([], out_type)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = pa.array(quantiser.cell(v).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cell, pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "cell", "v"])

    indexed = spill_table(rows.mapInArrow(place, "vec_id bigint, cell int, v binary").withColumn("rid", F.monotonically_increasing_id()), "multi-index")
    counts = np.zeros(quantiser.cells, dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row per cell
        counts[r.cell] = r["count"]
    total = int(counts.sum())
    wanted = total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = Blocks(counts, min(MOST_BLOCK, max(LEAST_BLOCK, wanted)))
    enough = max(quantiser.share * total, k + 1)

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for rid, vec_id, v in zip(*(batch.column(c).to_pylist() for c in ("rid", "vec_id", "v")), strict=True):
                for block, cells in blocks.of_visit(quantiser.visit(np.frombuffer(v), counts, enough)):
                    for column, x in zip(columns, (block, rid, vec_id, v, cells), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "rid", "vec_id", "v", "cells"])

    probes = spill_table(indexed.where(is_query).select("rid", "vec_id", "v").mapInArrow(to_probes, "block int, rid bigint, vec_id bigint, v binary, cells binary"), "probes")
    # of each block as many copies as its queries need tasks: one row per block
    copies = np.zeros(blocks.number, dtype=np.int64)
    for r in probes.groupBy("block").count().collect():
        copies[r.block] = -(-r["count"] // QUERIES)

    def to_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rid = batch.column("cell").to_numpy(), batch.column("rid").to_numpy()
            block = blocks.of_rows(cell, rid)
            times = copies[block]
            which = np.repeat(np.arange(block.size), times)
            part = np.arange(which.size) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(which))
            at = [pa.array(x.astype(np.int32)) for x in (block[which], part)]
            yield pa.RecordBatch.from_arrays([*at, *(taken.column(c) for c in ("rid", "vec_id", "cell", "v"))], ["block", "part", "rid", "vec_id", "cell", "v"])

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("rid").to_numpy() % np.maximum(1, copies[batch.column("block").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(part.astype(np.int32)), *(batch.column(c) for c in ("rid", "vec_id", "v", "cells"))], ["block", "part", "rid", "vec_id", "v", "cells"])

    matrix = lambda values: np.frombuffer(b"".join(values.to_pylist())).reshape(len(values), -1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block and part, the entries of each before its queries."""
        current, held, ready = None, [], None
        for batch in batches:
            block, part = batch.column("block").to_numpy(), batch.column("part").to_numpy()
            query = batch.column("cells").is_valid().to_numpy(zero_copy_only=False)
            change = (np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(query.view(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if (block[lo], part[lo]) != current:
                    current, held, ready = (block[lo], part[lo]), [], None
                if not query[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if ready is None and not held:  # a part of a split cell that got no rows
                    continue
                if ready is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ready = matrix(rows.column("v")), rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy(), rows.column("cell").to_numpy() - blocks.lows[current[0]]
                    held = []
                for at in range(lo, hi, 256):
                    yield found(batch.slice(at, min(256, hi - at)), *ready)

    def found(queries: pa.RecordBatch, entries: np.ndarray, rids: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        bits = np.frombuffer(b"".join(queries.column("cells").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
        q_rid, q_id = queries.column("rid").to_numpy(), queries.column("vec_id").to_numpy()
        allowed = np.unpackbits(bits, axis=1).astype(bool)[:, cells] & (q_rid[:, None] != rids[None, :])
        out: list[list] = [[], [], [], []]
        for i, (at, scores) in enumerate(top_scores(matrix(queries.column("v")), entries, allowed, ids, k)):
            for column, x in zip(out, ([q_rid[i]] * at.size, [q_id[i]] * at.size, ids[at], scores), strict=True):
                column.extend(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_rid", "query_id", "vec_id", "score"])

    entries = indexed.mapInArrow(to_entries, "block int, part int, rid bigint, vec_id bigint, cell int, v binary")
    asked = probes.mapInArrow(to_parts, "block int, part int, rid bigint, vec_id bigint, v binary, cells binary")
    met = entries.unionByName(asked, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", F.col("cells").isNotNull())
    scored = met.mapInArrow(score, "query_rid bigint, query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_rid").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
