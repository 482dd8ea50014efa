"""Chunks of whole documents, and the exchange that tells each chunk which of its fingerprints others have too.

A chunk is one row of a staged table: the ids and texts of some documents, about 4 MB (one longer text is a chunk
of its own). A chunk sends each of its distinct fingerprints once, packed into one block of bytes for each bucket;
a bucket sorts what it got and answers each block with bits, in the block's order. So a fingerprint that a third
of all documents hold costs one entry a chunk, no bucket gathers more than its share of distinct values, and the
answers are small enough to join back to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivana.llm.common import blocks, by_groups, no_nulls, parts_for

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Up to this much input, chunks and buckets keep their sizes; beyond it both grow with its root, so that the blocks between
#: them keep theirs, up to the largest sizes. A task takes some 15 chunks or 8 buckets of memory.
STEADY_BYTES = 32 << 30
LARGEST_CHUNK, LARGEST_BUCKET = 32 << 20, 256 << 20

CHUNKS = "chunk long, doc_ids array<long>, texts array<string>"


def chunk_bytes(n: int, least: int) -> int:
    return int(min(LARGEST_CHUNK, least * max(1.0, math.sqrt(n / STEADY_BYTES))))


def as_chunks(rows: DataFrame, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """rows: (doc_id long, text string), in the order that chunks shall have within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for table in blocks(batches, "text", most_bytes):
            one = np.array([0, table.num_rows], dtype=np.int32)
            texts = no_nulls(table.column("text")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array(one), table.column("doc_id").combine_chunks()), pa.ListArray.from_arrays(pa.array(one), texts)], names=["chunk", "doc_ids", "texts"])
            number += 1

    return rows.mapInArrow(run, CHUNKS)


def of_chunk(batch: pa.RecordBatch, i: int) -> tuple[int, pa.Array, pa.Array]:
    """Number, doc_ids and texts of one chunk."""
    row = batch.slice(i, 1)
    return row.column(0)[0].as_py(), row.column(1).flatten(), row.column(2).flatten()


def entry_bytes(n: int, least: int = 8) -> int:
    """Width at which n random values have a chance of about 2**-17 to collide at all."""
    return min(16, max(least, math.ceil((2 * math.log2(max(n, 2)) + 16) / 8)))


def buckets_for(n: int, width: int, n_bytes: int) -> int:
    """For n values of ``width`` bytes from so many bytes of text."""
    return parts_for(n * width, int(min(LARGEST_BUCKET, BUCKET_BYTES * max(1.0, math.sqrt(n_bytes / STEADY_BYTES)))))


class Distinct:
    """The distinct pairs of two 64-bit values, cut to ``width`` bytes, in order, and what became of each input."""

    def __init__(self, one: np.ndarray, two: np.ndarray, width: int):
        keep = 8 * (width - 8)
        two = two & np.uint64((1 << keep) - 1) if keep < 64 else two
        order = np.lexsort((two, one)) if keep else np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.one, self.two, self.width = a[new], b[new], width
        self.place = np.empty(len(a), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.times = np.diff(np.append(at, len(a)))
        self.first = order[at]

    def buckets(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets that have values, and where theirs begin and end."""
        tops = bucket_of(self.one, n_buckets)
        start = np.flatnonzero(np.concatenate([[len(tops) > 0], tops[1:] != tops[:-1]]))
        return tops[start], start, np.append(start[1:], len(tops))

    def packed(self, start: int, end: int) -> bytes:
        return pack(self.one[start:end], self.two[start:end], self.width)


def bucket_of(values: np.ndarray, n_buckets: int) -> np.ndarray:
    """Even ranges of the values' upper half."""
    return (values >> np.uint64(32)).astype(np.int64) * n_buckets >> 32


def pack(one: np.ndarray, two: np.ndarray, width: int) -> bytes:
    out = np.empty((len(one), width), dtype=np.uint8)
    out[:, :8] = one.view(np.uint8).reshape(-1, 8)
    out[:, 8:] = two.view(np.uint8).reshape(-1, 8)[:, : width - 8]
    return out.tobytes()


def unpack(block: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(block, dtype=np.uint8).reshape(-1, width)
    two = np.zeros((len(rows), 8), dtype=np.uint8)
    two[:, : width - 8] = rows[:, 8:]
    return np.ascontiguousarray(rows[:, :8]).view(np.uint64).ravel(), two.view(np.uint64).ravel()


#: Texts of one chunk to two 64-bit values for each fingerprint.
Fingerprints = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

BLOCKS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def repeated_elsewhere(chunks: DataFrame, fingerprints: Fingerprints, width: int, n_buckets: int) -> DataFrame:
    """(chunk, answers): for every chunk its bits, bucket by bucket: does another chunk hold this value?"""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, _, texts = of_chunk(batch, i)
                own = Distinct(*fingerprints(texts), width)
                full = list(zip(*own.buckets(n_buckets)))
                for k in range(0, len(full), 64):
                    some = full[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([own.packed(x[1], x[2]) for x in some], pa.binary())], schema=BLOCKS)

    def answer(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, chunk = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
        for a, b in zip(ends, ends[1:]):
            held = table.column("block").slice(a, b - a).to_pylist()
            sizes = np.array([len(x) // width for x in held])
            one, two = unpack(b"".join(held), width)
            held.clear()
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            flags = np.zeros(len(one), dtype=bool)
            flags[order[1:]] |= same
            flags[order[:-1]] |= same
            bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[a:b]), pa.array(bucket[a:b]), pa.array(bits, pa.binary())], schema=ANSWERS)

    blocks_ = chunks.mapInArrow(send, "bucket int, chunk long, block binary")
    answers = by_groups(blocks_, ["bucket"], answer, "chunk long, bucket int, bits binary")
    return answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


def answered(own: Distinct, answers: list[dict] | None, n_buckets: int) -> np.ndarray:
    """The bits of a chunk's distinct values, in their order."""
    places = {int(n): (a, b) for n, a, b in zip(*own.buckets(n_buckets))}
    out = np.zeros(len(own.one), dtype=bool)
    for x in answers or ():
        a, b = places[x["bucket"]]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=b - a).astype(bool)
    return out
