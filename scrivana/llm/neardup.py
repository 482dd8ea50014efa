"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

A document's set holds its distinct five-word shingles (lower-cased A-Z; fewer words: the whole sequence; no
words: the empty set, linked with nothing). Two documents are linked if the Jaccard similarity of their sets is
at least 0.75; groups are the connected components.

1. One pass over the texts keeps, for each document, the size of its set, a 128-bit digest of it and the minima of
   128 universal hash functions. Documents with the same digest are one class from here on.
2. 32 bands of 4 minima make buckets. A pair at the threshold shares no bucket with probability (1 - 0.75**4)**32,
   5e-6. A bucket of any size is split into blocks; in a block, members are compared with a medoid, those that are
   near it are taken out, and so on, as long as someone is near (what a block leaves is step 4's). Block medoids meet in
   the same way.
3. Pairs are first verified by their signatures (an estimate 5 standard deviations below the threshold is refused),
   then on full sets.
4. After a first round of components, each bucket with members of two or more components compares all of them
   block by block, but only pairs of different components, and each pair in its first common bucket alone. What the
   signatures don't refuse is verified on full sets in place, and only links that tie components together come out:
   no connection is lost, and neither copies nor unlike members of a large group are expanded into rows of pairs.
   The components of both rounds' links are the result.

Nulls count as empty texts; rows that repeat a doc_id are documents of their own, all of them returned, and of different
texts each is grouped by its own; a null doc_id is left out; an empty table gives an empty table; other columns are not
read. Repeated ids apart, ties don't arise.

Hot keys: copies are one class before any bucket is made, and texts without words stay out of every join. The tables
that a hot key meets (classes, bucket sizes, least neighbours) are written first, so a join is a broadcast of a counted
table or one that Spark can split where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch, Words, blocks, by_groups, mix64
from scrivana.llm.components import connected_components

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Five standard deviations of an estimate from 128 minima at similarity 0.75.
REFUSE_BELOW = 0.75 - 5 * (0.75 * 0.25 / HASHES) ** 0.5
#: An estimate that takes a member out of a block's further comparisons.
NEAR = 0.7
BLOCK = 512
#: Rows of a written table that may be broadcast, some 70 bytes each in memory.
BROADCAST_IDS = 250_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = [np.uint64(int(x)) for x in _rng.integers(1 << 62, 1 << 63, WIDTH) | 1]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of a block of texts, and where each text's begin (end appended)."""
    words = Words(texts, lower=True)
    first, _ = words.hashed()
    n_docs = len(words.start) - 1
    n_words = np.diff(words.start)
    n = len(first) - WIDTH + 1
    if n > 0:
        values = first[:n] * _C[0]
        for k in range(1, WIDTH):
            values += first[k : n + k] * _C[k]
        values = mix64(values)
    else:
        values = np.zeros(0, dtype=np.uint64)
    counts = np.where(n_words >= WIDTH, n_words - WIDTH + 1, 0)
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1] if n_docs else 0) + np.repeat(words.start[:-1] - (ends - counts), counts)
    sets = [np.unique(s) for s in np.split(values[inside], ends[:-1])] if n_docs else []
    for i in np.flatnonzero((n_words > 0) & (n_words < WIDTH)):
        own = first[words.start[i] : words.start[i + 1]]
        whole = np.array([len(own)], dtype=np.uint64)
        for k, x in enumerate(own):
            whole = whole * _C[k] + x
        sets[i] = mix64(whole)
    return (np.concatenate(sets) if sets else values[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minima(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set (of those that aren't empty), as 32-bit numbers."""
    out = np.empty((len(start) - 1, HASHES), dtype=np.uint32)
    short = flat >> np.uint64(32)
    step = 1 << 15
    i = 0
    while i < len(start) - 1:
        j = max(i + 1, int(np.searchsorted(start, start[i] + step, side="right")) - 1)
        part, cuts = short[start[i] : start[j]], start[i:j] - start[i]
        hashed = np.empty_like(part)
        for h in range(HASHES):
            np.multiply(part, _A[h], out=hashed)
            hashed += _B[h]
            out[i:j, h] = np.minimum.reduceat(hashed, cuts) >> np.uint64(32)
        i = j
    return out


SIGNED = "doc_id long, its_text long, n_shingles long, digest binary, signature binary"


def digest_of(flat: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(flat.tobytes())


def sign(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, its_text, text), ``its_text`` being a hash that tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", 1 << 20):
            flat, start = shingle_sets(table.column("text"))
            sizes = np.diff(start)
            full = sizes > 0
            signed = iter(minima(flat, np.concatenate([start[:-1][full], start[-1:]])) if full.any() else ())
            signatures = [next(signed).tobytes() if f else b"" for f in full]
            digests = [digest_of(flat[a:b]) for a, b in zip(start, start[1:])]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("its_text").combine_chunks(), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "its_text", "n_shingles", "digest", "signature"])

    return docs.mapInArrow(run, SIGNED)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(bucket, band, node): one row a band for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            s = signatures(batch.column(1))
            pairs = s.reshape(len(s), BANDS, ROWS).astype(np.uint64)
            key = mix64((pairs[:, :, 0] << np.uint64(32) | pairs[:, :, 1]) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key = mix64(key ^ mix64((pairs[:, :, 2] << np.uint64(32) | pairs[:, :, 3]) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(s))), pa.array(np.repeat(nodes, BANDS))], names=["bucket", "band", "node"])

    return classes.select("node", "signature").mapInArrow(run, "bucket long, band int, node long")


def signatures(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def medoid_pairs(nodes: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
    """Medoid by medoid: the member that agrees most with the column-wise commonest minima, and all near it."""
    order = np.argsort(nodes, kind="stable")
    nodes, s = nodes[order], s[order]
    left, out = np.arange(len(nodes)), []
    while len(left) > 1:
        own = s[left]
        ranked = np.sort(own, axis=0)
        same = ranked[1:] == ranked[:-1]
        run = np.zeros(own.shape[1], dtype=np.int32)
        best, common = np.zeros(own.shape[1], dtype=np.int32), ranked[0].copy()
        for i in range(len(same)):
            run = np.where(same[i], run + 1, 0)
            more = run > best
            best[more], common[more] = run[more], ranked[i + 1][more]
        middle = int(np.argmax((own == common).sum(axis=1)))
        alike = (own == own[middle]).mean(axis=1)
        alike[middle] = 0
        near = alike >= REFUSE_BELOW
        if not near.any():
            if len(left) <= 64:
                keep = np.ones(len(left), dtype=bool)
                keep[middle] = False
                left = left[keep]
                continue
            break
        out += [(int(nodes[left[middle]]), int(nodes[x])) for x in left[near]]
        keep = alike < NEAR
        keep[middle] = False
        left = left[keep]
    return out


def open_pairs(s: np.ndarray, comp: np.ndarray, block: np.ndarray, one: int, two: int, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions i and j > i in a group that may be linked: from blocks ``one`` and ``two``, of different components,
    not refused by their estimate, and in no common bucket of an earlier band (there the pair is looked at)."""
    split = s.reshape(len(s), BANDS, ROWS)
    for i in range(len(s)):
        far = np.flatnonzero(comp != comp[i])
        far = far[(far > i) & ((block[far] != block[i]) if one != two else (block[far] == one))] if len(far) else far
        if len(far):
            far = far[(s[far] == s[i]).mean(axis=1) >= REFUSE_BELOW]
        if len(far):
            far = far[(split[far] == split[i]).all(axis=2).argmax(axis=1) == band]
        if len(far):
            yield i, far


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common * DENOMINATOR >= (len(a) + len(b) - common) * NUMERATOR


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], schema=PAIR)


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast where its counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def in_blocks(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets of two or more members, each member with the number of its block."""
    sizes = scratch.put("sizes", buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return buckets.join(few(sizes), "bucket").select("bucket", "band", "node", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("node"), n_blocks.cast("long")).cast("int").alias("block"))


def first_pairs(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of each block with its medoids. members: (bucket, block, node)."""

    def run(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, s = table.column("node").to_numpy(), signatures(table.column("signature"))
        sizes = np.diff(ends)
        two = ends[:-1][sizes == 2]
        two = two[(s[two] == s[two + 1]).mean(axis=1) >= REFUSE_BELOW]
        pairs = list(zip(nodes[two].tolist(), nodes[two + 1].tolist()))
        for i in np.flatnonzero(sizes > 2):
            pairs += medoid_pairs(nodes[ends[i] : ends[i + 1]], s[ends[i] : ends[i + 1]])
        yield pair_batch(pairs)

    return by_groups(members.select("bucket", "block", "node").join(signed, "node"), ["bucket", "block"], run, "a long, b long").distinct()


def joined_blocks(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """For buckets of several blocks: the ends of ``pairs``' medoids, put into fewer blocks, to tie blocks together."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    medoids = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("node")
    wide = members.where("n_blocks > 1").join(medoids, "node")
    sizes = wide.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("fewer"))
    return wide.join(sizes, "bucket").select("bucket", "node", F.pmod(F.xxhash64("node", F.lit(1)), F.col("fewer").cast("long")).cast("int").alias("block"))


GRID = "bucket long, i int, j int, band int, block int, node long, component long"


def later_links(members: DataFrame, signed: DataFrame, components: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links between different components in one bucket, block pair by block pair.

    A first pass on signatures finds the members that have a pair to look at; the second has their full sets, and
    returns no more links than tie the members of a block pair together.
    """
    placed = members.join(components, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    # the members of a bucket's largest component needn't meet one another: only the others meet all
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    split = scratch.put("split", split.select("bucket", F.col("most.component").alias("largest"), blocks_of(F.col("n") - F.col("most.n")).alias("of_others"), blocks_of(F.col("most.n")).alias("of_largest")))
    open_ = placed.join(few(split), "bucket").withColumn("in_largest", F.col("component") == F.col("largest"))
    within = F.pmod(F.xxhash64("node"), F.when(F.col("in_largest"), F.col("of_largest")).otherwise(F.col("of_others")).cast("long")).cast("int")
    open_ = open_.withColumn("block", within + F.when(F.col("in_largest"), F.col("of_others")).otherwise(0))
    meets = F.col("of_others") + F.when(F.col("in_largest"), 0).otherwise(F.col("of_largest"))
    grid = open_.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    grid = grid.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "component")

    def groups(table: pa.Table, ends: np.ndarray):
        columns = [table.column(c).to_numpy() for c in ("i", "j", "band", "block", "node", "component")]
        s = signatures(table.column("signature"))
        for a, b in zip(ends, ends[1:]):
            i, j, band, block, node, comp = (c[a:b] for c in columns)
            yield a, node, comp, open_pairs(s[a:b], comp, block, i[0], j[0], band[0])

    def wanted(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(table.num_rows, dtype=bool)
        for a, _, _, pairs in groups(table, ends):
            for x, ys in pairs:
                keep[a + x] = True
                keep[a + ys] = True
        yield from table.drop_columns(["signature"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def link(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets, found = table.column("shingles"), []
        for a, node, comp, pairs in groups(table, ends):
            held: dict[int, np.ndarray] = {}

            def of(x: int) -> np.ndarray:
                if x not in held:
                    held[x] = np.frombuffer(sets[a + x].as_py(), dtype=np.uint64)
                return held[x]

            top = np.unique(comp, return_inverse=True)[1]
            top = top.copy()
            for x, ys in pairs:
                for y in ys:
                    if top[x] != top[y] and similar(of(x), of(int(y))):
                        top[top == top[y]] = top[x]
                        found.append((int(node[x]), int(node[y])))
        yield pair_batch(found)

    keys = ["bucket", "i", "j"]
    some = scratch.put("open", by_groups(grid.join(signed, "node").select("bucket", "i", "j", "band", "block", "node", "component", "signature"), keys, wanted, GRID))
    sets = scratch.put("open-sets", full_sets(docs, some.select("node").distinct(), classes, scratch, "open", as_bytes=True))
    return by_groups(some.join(signed, "node").join(sets, "node"), keys, link, "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, scratch: Scratch, tag: str, as_bytes: bool = False) -> DataFrame:
    """(node, shingles) of these classes, from the text of their first document."""
    wanted = scratch.put(f"{tag}-ids", classes.join(nodes, "node").select(F.col("least").alias("doc_id"), "node", F.col("digest").alias("wanted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", 1 << 20):
            flat, start = shingle_sets(table.column("text"))
            # rows of one id may have other texts
            right = np.array([digest_of(flat[a:b]) == w for a, b, w in zip(start, start[1:], table.column("wanted").to_pylist())], dtype=bool)
            if as_bytes:
                sets = pa.array([flat[a:b].tobytes() for a, b in zip(start, start[1:])], pa.binary())
            else:
                sets = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), sets], names=["node", "shingles"]).filter(pa.array(right))

    rows = docs.select("doc_id", "text").join(few(wanted), "doc_id").select("node", "wanted", "text")
    return rows.mapInArrow(run, f"node long, shingles {'binary' if as_bytes else 'array<long>'}")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = scratch.put(f"{tag}-sets", full_sets(docs, nodes, classes, scratch, tag))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - common
    return both.where(common * F.lit(DENOMINATOR) >= either * F.lit(NUMERATOR)).select("a", "b").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; and its_text (xxhash64 of the text) and component, a number of the group (null for texts without words)."""
    scratch = scratch or Scratch(spark, "neardup")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("its_text"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    signed = scratch.put("signed", sign(own))
    if not signed.groupBy("doc_id", "its_text").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["doc_id", "its_text"])  # where texts are read again, one of equal rows is enough
    # one row a set: its signature is that of any document that has it
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    reps = scratch.put("reps", classes.withColumn("node", F.monotonically_increasing_id()))
    classes = reps.select("digest", "least", "node")
    signatures_ = reps.select("node", "signature")
    members = scratch.put("members", in_blocks(bucket_rows(reps), scratch))

    pairs = scratch.put("pairs-0", first_pairs(members, signatures_))
    pairs = scratch.put("pairs-1", pairs.union(first_pairs(joined_blocks(members, pairs), signatures_)).distinct())
    links = scratch.put("links-1", verify(pairs, own, classes, scratch, "verify-1"))
    components = scratch.put("components-1", connected_components(links, scratch, "cc-1"))
    scratch.drop("verify-1-sets")
    links = links.union(scratch.put("links-2", later_links(members, signatures_, components, own, classes, scratch)))
    components = scratch.put("components-2", connected_components(links, scratch, "cc-2"))
    grouped = scratch.put("grouped", classes.join(components, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component")))
    firsts = scratch.put("firsts", grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    grouped = scratch.put("placed", grouped.join(firsts, "component").select("digest", "component", "component_id"))
    rows = signed.select("doc_id", "its_text", "n_shingles", "digest")
    with_words = rows.where("n_shingles > 0").join(grouped, "digest").select("doc_id", "its_text", "n_shingles", "component", "component_id")
    without = rows.where("n_shingles = 0").select("doc_id", "its_text", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return with_words.union(without).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "its_text", "component")
