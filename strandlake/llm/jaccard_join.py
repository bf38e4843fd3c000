"""Jaccard similarity join over word n-grams, by rare-first prefix filtering.

A document is its set of distinct n-word shingles, as 64-bit hashes. Two documents link when
100 * |intersection| >= percent * |union|. The links' connected components are found exactly:

1. Frequencies of shingles over all documents go into a table of 2^TABLE_BITS counters, summed by Spark:
   its size is fixed. They order shingles, rare first (on a scale of half octaves, ties by hash).
2. Documents with equal sets form one class and go on as one. A linked pair shares one of each side's first
   n - ceil(t * n) + 1 shingles in that order; only these prefixes become postings, and only those of
   shingles that two classes share are kept. A bucket is the postings of one shingle.
3. Pairs of a bucket that pass the length and positional filters become candidates, and each candidate
   pair is verified once, against whole texts. Suffix filters come first: a parity sketch (whether each of
   PARITY hash ranges holds an odd number of shingles; as many ranges as differ, at least as many shingles
   do), then the sets halved a few times; then the intersection. A group of copies would give all its
   pairs, so buckets proceed in rounds: a round pairs some leaders of every bucket (1, then 64, 4096, ...)
   with its members, except pairs that are verified already or connected already by links found before. A
   bucket is done once it has no more members than the round has leaders, or all are connected, and of
   buckets with the same members one goes on. No pair that could still connect two components is left
   out; a group of many near copies costs about as many verifications as it has members.
4. On demand, links are counted: all of them lie inside components, so every pair of a component's classes is
   compared by its exact intersection, in cells of two blocks of CELL classes or so, whose sets are made once a
   cell. Copies count by their class's size. A component of two classes has one link.

Texts of the classes that reach verification are kept, compressed, in the shared folder. A membership filter of
fixed size (2^FILTER_BITS bits, by id) spares the other documents the exchange.

Defined cases: null and empty texts have empty sets and link with nothing; a text with fewer than n words
has one shingle, its whole sequence; rows are documents, so rows with equal ids are joined by their own
texts; a null id is nobody's component id unless all ids of the component are null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import cut, mix64, shingle_sets, sized_batches, spill_table, temporary_tables, texts_of
from strandlake.llm.graph import components

TABLE_BITS = 24
#: The counters travel in this many parts.
PARTS = 64
FILTER_BITS = 23
LEADERS = 64
SUFFIX_DEPTH = 4
#: Hash ranges of the parity sketch: bits, a multiple of 64.
PARITY = 1024
#: Bytes of text whose shingles are made at a time.
BLOCK = 1 << 20
#: Classes of a component that go into a cell from either side, on average; shingles of a cell compared at a time.
CELL, CELL_SHINGLES = 128, 1 << 19


def _table_index(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def shingle_rarity(docs: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of each counter are over every document's set, in half octaves (0 to 63).

    Counters are picked by a shingle's top hash bits: a shingle is at least as rare as its counter says."""
    size = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        for batch in sized_batches(batches, "text", BLOCK):
            _, hashes = shingle_sets([t.encode() for t in texts_of(batch)], words)
            at, found = np.unique(_table_index(hashes), return_counts=True)
            total[at] += found.astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        for part, counts in enumerate(total.reshape(PARTS, -1)):
            # bytes of equal weight together: most of the upper ones are 0
            planes = np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([press.compress(planes)], pa.binary())], ["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                counts = np.ascontiguousarray(np.frombuffer(read.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                sums[part] = sums.get(part, np.zeros(counts.size, np.int64)) + counts
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rarity(counts).tobytes()], pa.binary())], ["part", "data"])

    summed = docs.select("text").mapInArrow(count, "part int, data binary").repartition("part").mapInArrow(add, "part int, data binary")
    out = np.zeros((PARTS, size // PARTS), dtype=np.uint8)
    for r in summed.collect():  # PARTS rows, one byte a counter
        out[r.part] = np.frombuffer(r.data, np.uint8)
    return out.ravel()


def rarity(counts: np.ndarray) -> np.ndarray:
    return np.minimum(63, 2 * np.log2(counts + 1)).astype(np.uint8)


def ordered_prefix(hashes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The set's first shingles, rare first, as keys that hold the rarity and most of the hash."""
    n = hashes.size
    p = n - (percent * n + 99) // 100 + 1
    level = levels[_table_index(hashes)].astype(np.uint64)
    keys = (level << np.uint64(58)) | (hashes >> np.uint64(6))
    return np.sort(np.partition(keys, p - 1)[:p])


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set."""
    a = int(mix64(hashes).sum(dtype=np.uint64)) ^ hashes.size
    b = int(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def signatures(docs: DataFrame, table: Broadcast, words: int, percent: int, rid: str | None = None) -> DataFrame:
    """(doc_id, n, c1, c2, prefix, parity, and rid if named) of every row. table: shingle_rarity's, broadcast."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in sized_batches(batches, "text", BLOCK):
            bounds, hashes = shingle_sets([t.encode() for t in texts_of(batch)], words)
            n, c1, c2, prefix, parity = [], [], [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                one = hashes[lo:hi]
                a, b = class_of(one) if one.size else (0, 0)
                n.append(one.size)
                c1.append(a)
                c2.append(b)
                prefix.append(ordered_prefix(one, table.value, percent).view(np.int64) if one.size else none)
                odd = np.bincount((one % np.uint64(PARITY)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1
                parity.append(np.packbits(odd).view(np.int64))
            columns = [*(pa.array(x, pa.int64()) for x in (n, c1, c2)), *(pa.array(x, pa.list_(pa.int64())) for x in (prefix, parity))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in given), *columns], [*given, "n", "c1", "c2", "prefix", "parity"])

    given = ["doc_id"] if rid is None else ["doc_id", "rid"]
    read = [F.col("doc_id").cast("long").alias("doc_id"), *([] if rid is None else [F.col(rid).alias("rid")]), "text"]
    kept = ", ".join(f"{x} bigint" for x in (*given, "n", "c1", "c2")) + ", prefix array<bigint>, parity array<bigint>"
    return docs.select(*read).mapInArrow(sign, kept)


def class_texts(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(rep, body): compressed texts of the classes (rep, doc_id, c1, c2)."""
    size = 1 << FILTER_BITS
    at = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(size)) + 1  # the bitmap functions count from 1
    bits = classes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    member = np.zeros((size // 32768, 32768), dtype=bool)
    for r in bits.collect():  # 2^FILTER_BITS bits at most
        member[r.bucket - 1] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(member.ravel()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdCompressor(level=3), np.unpackbits(packed.value).astype(bool)
        for batch in sized_batches(batches, "text", BLOCK):
            batch = batch.filter(pa.array(known[batch.column("doc_id").fill_null(0).to_numpy() % size]))
            texts = [t.encode() for t in texts_of(batch)]
            bounds, hashes = shingle_sets(texts, words)
            names = [class_of(hashes[lo:hi]) if hi > lo else (0, 0) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [*(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([press.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "c1", "c2", "body"])

    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keep, "doc_id bigint, c1 bigint, c2 bigint, body binary")
    same = classes["doc_id"].eqNullSafe(bodies["doc_id"]) & (classes["c1"] == bodies["c1"]) & (classes["c2"] == bodies["c2"])
    return classes.join(bodies, same).select("rep", "body").dropDuplicates(["rep"])


def overlap_bound(a: np.ndarray, b: np.ndarray, need: int, depth: int = SUFFIX_DEPTH) -> int:
    """Suffix filter: at most this many elements are common; less than `need` ends it early.

    Both sets are cut at the median of the larger, again and again; parts can share no more than the smaller has."""
    if depth == 0 or min(a.size, b.size) < 8:
        return min(a.size, b.size)
    if a.size < b.size:
        a, b = b, a
    mid = a.size // 2
    at = int(np.searchsorted(b, a[mid]))
    left_most, right_most = min(mid, at), min(a.size - mid, b.size - at)
    if left_most + right_most < need:
        return left_most + right_most
    left = overlap_bound(a[:mid], b[:at], need - right_most, depth - 1)
    if left + right_most < need:
        return left + right_most
    return left + overlap_bound(a[mid:], b[at:], need - left, depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: 100 * |intersection| >= percent * |union|."""
    need = -(-percent * (a.size + b.size) // (100 + percent))
    if min(a.size, b.size) < need or overlap_bound(a, b, need) < need:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def verified(pairs: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Joined on b, then on a: a leader's many pairs arrive together and its
    set is made once; a leader with very many is split among tasks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, kept = zstandard.ZstdDecompressor(), OrderedDict()
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                new = {i: t for i, t in zip(a, batch.column("body_a").to_pylist(), strict=True) if i not in kept}
                texts = [read.decompress(t) for t in [*new.values(), *batch.column("body_b").to_pylist()]]
                bounds, hashes = shingle_sets(texts, words)
                sets = [hashes[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                kept.update(zip(new, (s.copy() for s in sets), strict=False))
                hit = [linked(kept[i], s, percent) for i, s in zip(a, sets[len(new) :], strict=True)]
                while len(kept) > 16:
                    kept.popitem(last=False)
                yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    with_b = pairs.join(bodies.select(F.col("rep").alias("b"), F.col("body").alias("body_b")), "b")
    with_both = with_b.join(bodies.select(F.col("rep").alias("a"), F.col("body").alias("body_a")), "a")
    return with_both.select("a", "b", "body_a", "body_b").mapInArrow(check, "a bigint, b bigint")


def _can_overlap(x: str, y: str, percent: int) -> str:
    """SQL: the sketches of rows x and y (named by prefix) leave room for a link. A link's sets differ in
    n + m - 2 * overlap shingles at most, and overlap >= percent * (n + m) / (100 + percent)."""
    differ = " + ".join(f"bit_count({x}parity[{i}] ^ {y}parity[{i}])" for i in range(PARITY // 64))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({x}n + {y}n)"


def overlapping(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity sketches leave room for a link."""
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(_can_overlap("a_", "b_", percent)).select("a", "b")


def candidates(postings: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of this round's leaders and their buckets' members that pass the filters.

    Later rounds' postings have labels and sketches, so that connected and far pairs aren't made at all."""
    if leaders == 1:
        lead = postings.groupBy("bucket").agg(F.min(F.struct("rep", "n", "pos")).alias("x")).select("bucket", "x.*")
    else:
        turn = W.partitionBy("bucket").orderBy(F.xxhash64(F.col("rep"), F.lit(leaders)), "rep")
        lead = postings.withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= leaders).drop("nth")
    named = lead.select("bucket", *(F.col(c).alias(f"l_{c}") for c in lead.columns if c != "bucket"))
    fits = (
        f"rep <> l_rep AND 100 * least(n, l_n) >= {percent} * greatest(n, l_n)"
        # common so far is at most the lesser place; what follows, at most the shorter rest
        f" AND {100 + percent} * (least(pos, l_pos) + least(n - pos, l_n - l_pos)) >= {percent} * (n + l_n)"
    )
    if leaders > 1:
        fits += f" AND label <> l_label AND {_can_overlap('', 'l_', percent)}"
    met = postings.join(named, "bucket").where(fits)
    # the leader comes first, so that its pairs meet; later the order only makes pairs distinct
    a, b = (F.col("l_rep"), F.col("rep")) if leaders == 1 else (F.least("rep", "l_rep"), F.greatest("rep", "l_rep"))
    return met.select(a.alias("a"), b.alias("b")).distinct()


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `sets` with each of `others`."""
    m, owner = len(sets), np.repeat(np.arange(len(sets) + len(others)), [x.size for x in (*sets, *others)])
    hashes = np.concatenate([*sets, *others])
    out = np.zeros((m, len(others)), dtype=np.int64)
    parts = 1 + hashes.size // CELL_SHINGLES
    for part in range(parts):
        mine = hashes % np.uint64(parts) == part
        _, at, found = np.unique(hashes[mine], return_inverse=True, return_counts=True)
        shared = found > 1
        kept = shared[at]
        at, rows = (np.cumsum(shared) - 1)[at[kept]], owner[mine][kept]
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
        for lo in range(0, int(shared.sum()), 4096):
            x, y = np.searchsorted(at, [lo, lo + 4096])
            has = np.zeros((m + len(others), 4096), dtype=np.float32)
            has[rows[x:y], at[x:y] - lo] = 1
            out += (has[:m] @ has[m:].T).astype(np.int64)
    return out


def link_counts(labels: DataFrame, classes: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """(rep, links): how many rows of other classes each class of the components (id, root) links with.

    classes: (rep, copies), the rows of each class."""
    members = labels.select(F.col("id").alias("rep"), "root").join(classes.select("rep", "copies"), "rep")
    sized = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("copies").alias("total"))
    members = cut(members.join(sized, "root"))
    two = members.where("m = 2").select("rep", (F.col("total") - F.col("copies")).alias("links"))

    blocks = F.ceil(F.col("m") / CELL)
    own = members.where("m > 2").join(bodies, "rep").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "body")

    def count(cell: pa.Table) -> pa.Table:
        read = zstandard.ZstdDecompressor()
        bounds, hashes = shingle_sets([read.decompress(t) for t in cell.column("body").to_pylist()], words)
        sets = [hashes[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        copies, side = cell.column("copies").to_numpy(), cell.column("own").to_numpy()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        common = intersections([sets[x] for x in a], [sets[x] for x in b]) if a.size and b.size else np.zeros((a.size, b.size), np.int64)
        sizes = np.diff(bounds)
        hit = 100 * common >= percent * (sizes[a][:, None] + sizes[b][None, :] - common)
        links = np.zeros(len(sets), dtype=np.int64)
        if i == j:
            np.fill_diagonal(hit, False)
            links[a] = hit @ copies[b]
        else:
            links[a], links[b] = hit @ copies[b], copies[a] @ hit
        return pa.table({"rep": cell.column("rep"), "links": pa.array(links, pa.int64())})

    counted = cells.groupBy("root", "i", "j").applyInArrow(count, "rep bigint, links bigint")
    return two.unionByName(counted.groupBy("rep").agg(F.sum("links").alias("links")))


def similar_groups(docs: DataFrame, words: int, percent: int, rid: str | None = None, links: bool = False) -> DataFrame:
    """Per row: rid, doc_id, n_shingles, component_id (the smallest doc_id of its component), group.

    rid: a column of docs that numbers its rows, to be carried along; by default rows get new numbers.
    links: also n_links, with how many other rows it links, copies included."""
    with temporary_tables():
        return cut(_similar_groups(docs, words, percent, rid, links))


def _similar_groups(docs: DataFrame, words: int, percent: int, rid: str | None, links: bool) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(shingle_rarity(docs, words))  # 2^TABLE_BITS bytes
    signed = signatures(docs, table, words, percent, rid)
    if rid is None:
        signed = signed.withColumn("rid", F.monotonically_increasing_id())
    signed = spill_table(signed, "signatures")
    table.destroy()
    rows = signed.select("rid", "doc_id", "n", "c1", "c2")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("rid", "doc_id")).alias("first"), F.count("*").alias("copies"))
    classes = spill_table(classes.select("c1", "c2", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("doc_id"), "copies"), "classes")

    prefixes = signed.select("rid", "n", "prefix").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    posted = prefixes.select(F.col("rid").alias("rep"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "bucket"))
    shared = posted.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    postings = spill_table(posted.join(shared, "bucket").select("bucket", "size", "rep", "n", "pos"), "postings")
    sketches = signed.select(F.col("rid").alias("rep"), F.col("n").cast("int").alias("n"), "parity")
    labels, bodies = _link_rounds(docs, classes, postings, sketches, words, percent)

    grouped = rows.where("n > 0").join(classes.select("c1", "c2", "rep", "copies"), ["c1", "c2"])
    if labels is not None:
        grouped = grouped.join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    else:
        grouped = grouped.withColumn("root", F.col("rep"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    counts, zero = [], []
    if links:
        n_links = F.col("copies") - 1
        if labels is not None:
            grouped = grouped.join(link_counts(labels, classes, bodies, words, percent), "rep", "left")
            n_links = n_links + F.coalesce("links", F.lit(0))
        counts, zero = [n_links.alias("n_links")], [F.lit(0).cast("long").alias("n_links")]
    found = grouped.join(least, "root").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("root").alias("group"), *counts)
    alone = rows.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("group"), *zero)
    return found.unionByName(alone)


def _link_rounds(docs: DataFrame, classes: DataFrame, postings: DataFrame, sketches: DataFrame, words: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Labels (id, root) of the classes that links connect, or None without links; texts of the verified classes."""
    tried = labels = bodies = None
    leaders, members = 1, postings.select("bucket", "rep", "n", "pos")
    open_buckets = members
    while True:
        pairs = candidates(open_buckets, leaders, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = spill_table(overlapping(pairs, sketches, percent) if leaders == 1 else pairs, "pairs")
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = ordered if tried is None else tried.unionByName(ordered)
        needed = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        if bodies is not None:
            needed = needed.join(bodies.select("rep"), "rep", "left_anti")
        wanted = cut(classes.join(needed, "rep", "left_semi"))
        if not wanted.isEmpty():
            more = spill_table(class_texts(docs, wanted, words), "bodies")
            bodies = more if bodies is None else bodies.unionByName(more)
        new = cut(verified(pairs, bodies, words, percent)) if bodies is not None else None
        if new is not None and not new.isEmpty():
            labels = cut(components(new.select(F.col("a").alias("u"), F.col("b").alias("v")), labels))
        # buckets that this round didn't pair in full, and whose members aren't all connected
        if leaders == 1:
            members = postings.where(F.col("size") > 2).select("bucket", "rep", "n", "pos")
        labelled = members.withColumn("label", F.col("rep"))
        if labels is not None:
            labelled = members.join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
        state = labelled.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), *(F.bit_xor(F.xxhash64(F.col("rep"), F.lit(i))).alias(f"x{i}") for i in (1, 2))
        )
        left = state.where((F.col("size") > leaders) & (F.col("lo") != F.col("hi")))
        # of buckets with the same members one is enough: the positional filter holds for any common shingle
        left = left.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket"))
        labelled = spill_table(labelled.join(left, "bucket", "left_semi"), "open")
        if labelled.isEmpty():
            return labels, bodies
        members = labelled.drop("label")
        open_buckets = labelled.join(sketches.select("rep", "parity"), "rep")
        leaders *= LEADERS


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, with their columns: of each component the row with the smallest id (nulls last; of equal
    ids the one read first), and every row without words."""
    rid = "_rid"
    while rid.lower() in {c.lower() for c in docs.columns}:
        rid += "_"
    numbered = spill_table(docs.withColumn(rid, F.monotonically_increasing_id()), "documents")
    groups = similar_groups(numbered, words, percent, rid=rid)
    first = groups.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("x"))
    kept = first.select(F.col("x.rid").alias(rid)).unionByName(groups.where("n_shingles = 0").select(F.col("rid").alias(rid)))
    return numbered.join(kept, rid, "left_semi").select(*docs.columns)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_groups(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """The full join: op4's columns and each document's number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_groups(docs, words=3, percent=90, links=True).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (
  SELECT a, b FROM common JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.rid = w.rid
JOIN (SELECT r.a, min(v.doc_id) AS component_id FROM reach r JOIN w v ON v.rid = r.b GROUP BY r.a) m ON m.a = w.rid
"""

LINKS_ORACLE = ORACLE.replace("m.component_id\n", "m.component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links\n") + """
LEFT JOIN (SELECT a, count(*) AS n_links FROM edges GROUP BY a) k ON k.a = w.rid
"""
