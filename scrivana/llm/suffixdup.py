"""Suffix-array dedup of byte strings.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input, never cross documents, and overlaps count.

Not every suffix has to travel. Of the 24-byte pieces inside a string, the one with the least hash (the leftmost
of equals) is the string's anchor, whatever surrounds it, so equal strings have equal anchors at equal places.
Neighbouring strings with one anchor form a span of at most 76 bytes. Chunks hold ranges of doc_id, so the order of
chunks is the order of documents.

1. Each chunk sends the hash of each distinct (anchor, span) once. A bucket answers whether an anchor was sent more
   than once, by whatever span or chunk. An anchor that wasn't has strings that stand nowhere else.
2. All other spans are sent with their bytes to the anchor's bucket, each distinct one once a chunk (within a chunk,
   equal spans are found by hash and verified byte by byte). There a span that an earlier document holds whole, byte by
   byte, is repeated; of the rest, a string whose hash no other string has is equal to none, and the others' suffixes
   are sorted by hash-compared mergesort, common extensions of 50 bytes are verified byte by byte, and each run's least
   document decides. Anchors with very many spans send each distinct string, once a chunk,
   to a bucket by its own hash instead, so no group is gathered in one task.
3. The answers join the texts, and the marked bytes are cut.

Nulls count as empty; a text of fewer than 50 bytes stays whole; rows that repeat a doc_id are documents in the
order of their texts' first 32 characters, then of a hash; a null doc_id counts as the smallest; an empty table gives an empty table; other columns are
not read. What is left of a text may not be UTF-8, so it is returned as bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.chunks import Distinct, as_chunks, bucket_of, buckets_for, chunk_bytes, of_chunk, unpack
from scrivana.llm.common import Scratch, by_groups, in_ranges, mix64, parts_for, powers, text_bytes
from scrivana.llm.suffixes import Suffixes, equal_runs
from scrivana.llm.windowdup import intervals

LENGTH = 50
PIECE = 24
CHUNK_BYTES = 2 << 20
SORT_BYTES = 2 << 20
#: An anchor with more spans than this sends strings one by one.
MANY_SPANS = 4096
LEAST_BUCKETS = 24
BASES = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)
_PLACE = 24
_BLOCK = 1 << 20
_PAIRS = 1 << 15

_powers: dict[tuple[int, bool], np.ndarray] = {}


def power_table(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers kept between chunks of usual size."""
    at = (base, inverse)
    if n > len(_powers.get(at, ())):
        table = powers(pow(base, -1, 1 << 64) if inverse else base, max(n, CHUNK_BYTES + (1 << 17)))
        if n > 4 * CHUNK_BYTES:
            return table
        _powers[at] = table
    return _powers[at][:n]


def prefix_hashes(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    values = data.astype(np.uint64)
    values *= power_table(base, len(data))
    np.cumsum(values, out=out[1:])
    return out


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


class Spans:
    """The spans of the texts of one chunk: strings starting at first..last (in ``data``) have the anchor ``anchor``."""

    def __init__(self, texts: pa.Array, length: int = LENGTH, piece: int = PIECE):
        self.length, self.piece = length, piece
        column = texts.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
        buffer = column.buffers()[2] if len(column) else None
        whole = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
        self.data, self.start = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
        n, sizes = len(self.data), np.diff(self.start)
        starts = np.maximum(sizes - length + 1, 0)
        if not starts.sum():
            self.first = self.last = self.anchor = self.doc = np.zeros(0, dtype=np.int64)
            return
        valid = np.zeros(n + 1, dtype=np.int8)
        at, counted = self.start[:-1][starts > 0], starts[starts > 0]
        valid[at] = 1
        np.add.at(valid, at + counted, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)[: n - length + 1]
        prefix = prefix_hashes(self.data, BASES[0])
        hashes = prefix[piece:] - prefix[:-piece]
        del prefix
        hashes *= power_table(BASES[0], len(hashes), inverse=True)
        hashes = mix64(hashes)
        width = length - piece + 1
        owner = np.empty(n - length + 1, dtype=np.int64)
        for b in range(0, len(owner), _BLOCK):
            part = hashes[b : b + _BLOCK + width - 1]
            keys = (part >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(part), dtype=np.uint64)
            owner[b : b + _BLOCK] = (least_of(keys, width) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)[: _BLOCK] + b
        new = np.empty(len(owner), dtype=bool)
        new[0] = True
        new[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
        self.first = np.flatnonzero(new & valid)
        ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
        self.last = ends
        self.anchor = owner[self.first]
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1
        # least hashes are small ones: mixed again, anchors fill the buckets evenly
        self.piece_hash = mix64(hashes[self.anchor] + np.uint64(BASES[1]))

    def values(self, anchor_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two values for each span: the first begins with ``anchor_bits`` of its anchor's hash, the rest and all of the second hash the span.

        The two are chains of their own over the span's 8-byte words, so a bit of either counts in full, also among
        the spans of one anchor.
        """
        if not len(self.first):
            none = np.zeros(0, dtype=np.uint64)
            return none, none
        words = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))
        size = self.last + self.length - self.first
        shape = size.astype(np.uint64) << np.uint64(32) | (self.anchor - self.first).astype(np.uint64)
        one, two = mix64(shape + np.uint64(BASES[0])), mix64(shape + np.uint64(BASES[1]))
        for k in range(0, int(size.max()) - 7, 8):
            at = np.flatnonzero(size >= k + 8)
            word = words[self.first[at] + k]
            one[at], two[at] = mix64(one[at] ^ word), mix64(two[at] + word * np.uint64(BASES[1]))
        word = words[self.last + self.length - 8]
        one, two = mix64(one ^ word), mix64(two + word * np.uint64(BASES[1]))
        low = np.uint64(64 - anchor_bits)
        return self.piece_hash >> low << low | one >> np.uint64(anchor_bits), two


def anchor_bits_for(n_spans: int) -> int:
    """So many that different anchors hardly ever meet by chance; where they do, more is sorted and nothing else changes."""
    return min(55, math.ceil(math.log2(n_spans) + 12))


def distinct_spans(spans: Spans, anchor_bits: int) -> tuple[Distinct, np.ndarray, np.ndarray]:
    """The chunk's distinct spans by hash; for each span the first that equals it byte by byte; and the spans, of one
    hash with an earlier one, that don't."""
    own = Distinct(*spans.values(anchor_bits), 16)
    spoke, size = own.first[own.place], spans.last + spans.length - spans.first
    again = np.flatnonzero(spoke != np.arange(len(spoke)))
    alike = size[again] == size[spoke[again]]
    alike[alike] = equal_ranges(spans.data, spans.first[again[alike]], spans.first[spoke[again[alike]]], size[again[alike]])
    wrong = again[~alike]
    spoke[wrong] = wrong
    return own, spoke, wrong


ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
OPEN, MANY = 1, 2
#: Bytes of a span's hash that are sent.
WIDTH = 10


def span_answers(chunks: DataFrame, anchor_bits: int, n_buckets: int) -> DataFrame:
    """(chunk, answers): one byte for each distinct span of the chunk, in order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, _, texts = of_chunk(batch, i)
                own = Distinct(*Spans(texts).values(anchor_bits), 16)
                own.width = WIDTH
                full = list(zip(*own.buckets(n_buckets)))
                for k in range(0, len(full), 64):
                    some = full[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([own.packed(x[1], x[2]) for x in some], pa.binary())], names=["bucket", "chunk", "block"])

    def answer(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, chunk = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
        for a, b in zip(ends, ends[1:]):
            by_chunk = a + np.argsort(chunk[a:b], kind="stable")
            held = [table.column("block")[int(i)].as_py() for i in by_chunk]
            sizes = np.array([len(x) // WIDTH for x in held])
            one, two = unpack(b"".join(held), WIDTH)
            held.clear()
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new_span = np.ones(len(one), dtype=bool)
            new_span[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            top = one >> np.uint64(64 - anchor_bits)
            begins = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
            sent, spans = np.diff(np.append(begins, len(one))), np.add.reduceat(new_span.astype(np.int64), begins)
            code = np.repeat(np.where(spans > MANY_SPANS, MANY, np.where(sent > 1, OPEN, 0)), sent)
            out = np.empty(len(one), dtype=np.uint8)
            out[order] = code
            yield pa.RecordBatch.from_arrays([pa.array(chunk[by_chunk]), pa.array(bucket[by_chunk]), pa.array([x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], pa.binary())], schema=ANSWER)

    answers = by_groups(chunks.mapInArrow(send, "bucket int, chunk long, block binary"), ["bucket"], answer, "chunk long, bucket int, bits binary")
    return answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


#: kind 0: a chunk's marks so far (bits); its open strings, by sort bucket: first and last start of each span; and
#: starts that copy the marks of others: to, from, how many in a row.
#: kind 1: what goes to a sort bucket: for each span its last start after the first (one byte), its anchor's place
#: (one byte; NO_ANCHOR: a string by itself) and its document (four bytes), and the bytes of all of them.
OPENED = "kind int, chunk long, bucket int, marks binary, first array<int>, last array<int>, copy_to array<int>, copy_from array<int>, copied array<int>, extra binary, places binary, docs binary, data binary"
_OPENED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary()), *((name, pa.list_(pa.int32())) for name in ("first", "last", "copy_to", "copy_from", "copied")), *((name, pa.binary()) for name in ("extra", "places", "docs", "data"))])
NO_ANCHOR = 255


def open_spans(chunks: DataFrame, answers: DataFrame, anchor_bits: int, n_buckets: int, n_sorts: int) -> DataFrame:
    """What the answers settle, and the spans that remain, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, _, texts = of_chunk(batch, i)
                yield from one_chunk(chunk, texts, batch.column(3)[i].as_py())

    def one_chunk(chunk: int, texts: pa.Array, answers: list[dict] | None) -> Iterator[pa.RecordBatch]:
        spans = Spans(texts)
        own, spoke, wrong = distinct_spans(spans, anchor_bits)
        places = {int(n): (a, b) for n, a, b in zip(*own.buckets(n_buckets))}
        code = np.zeros(len(own.one), dtype=np.uint8)
        for x in answers or ():
            a, b = places[x["bucket"]]
            code[a:b] = np.frombuffer(x["bits"], dtype=np.uint8)
        # the first of equal spans speaks for all: later documents repeat it, its own one copies its answer
        code[own.place[wrong]] = np.maximum(code[own.place[wrong]], OPEN)
        code, first_of_all = code[own.place], spoke == np.arange(len(spoke))
        settled = spans.doc > spans.doc[spoke]
        open_ = ~settled & (code > 0)
        copy = np.flatnonzero(open_ & ~first_of_all)
        rest = np.flatnonzero(open_ & first_of_all)
        first, last, doc = spans.first[rest], spans.last[rest], spans.doc[rest]
        group, place = spans.piece_hash[rest] if len(rest) else np.zeros(0, dtype=np.uint64), spans.anchor[rest] - first
        begins, ends = [spans.first[settled]], [spans.last[settled]]
        copies = [(spans.first[copy], spans.first[spoke[copy]], spans.last[copy] - spans.first[copy] + 1)]
        many = code[rest] == MANY
        if many.any():
            counts = last[many] - first[many] + 1
            each = in_rows(first[many], counts)
            its_doc = np.repeat(doc[many], counts)
            prefix = prefix_hashes(spans.data, BASES[1])
            strings = mix64((prefix[each + spans.length] - prefix[each]) * power_table(BASES[1], len(spans.data), inverse=True)[each])
            _, least, same = np.unique(strings, return_index=True, return_inverse=True)
            least = least[same]
            again = np.flatnonzero(least != np.arange(len(each)))
            again = again[equal_ranges(spans.data, each[again], each[least[again]], np.full(len(again), spans.length))]
            later = its_doc[again] > its_doc[least[again]]
            begins.append(each[again[later]])
            ends.append(each[again[later]])
            near = again[~later]
            copies.append((each[near], each[least[near]], np.ones(len(near), dtype=np.int64)))
            alone = np.ones(len(each), dtype=bool)
            alone[again] = False
            few, each = ~many, each[alone]
            first, last = np.concatenate([first[few], each]), np.concatenate([last[few], each])
            group, doc = np.concatenate([group[few], strings[alone]]), np.concatenate([doc[few], its_doc[alone]])
            place = np.concatenate([place[few], np.full(len(each), NO_ANCHOR)])
        change = np.zeros(len(spans.data) + 1, dtype=np.int32)
        np.add.at(change, np.concatenate(begins), 1)
        np.add.at(change, np.concatenate(ends) + 1, -1)
        marks = np.cumsum(change[:-1]) > 0
        bucket = bucket_of(mix64(group.copy()), n_sorts) if len(group) else np.zeros(0, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        first, last, group, doc, place, bucket = (x[order] for x in (first, last, group, doc, place, bucket))
        yield row(0, chunk, None, np.packbits(marks).tobytes(), first, last, *(np.concatenate(x) for x in zip(*copies)))
        begin = np.flatnonzero(np.concatenate([[len(bucket) > 0], bucket[1:] != bucket[:-1]]))
        for b, x, y in zip(bucket[begin].tolist(), begin, np.append(begin[1:], len(bucket))):
            f, t = first[x:y], last[x:y] + spans.length
            n = t - f
            at = in_rows(f, n)
            yield row(1, chunk, b, None, None, None, None, None, None, *(z.tobytes() for z in ((last[x:y] - f).astype(np.uint8), place[x:y].astype(np.uint8), doc[x:y].astype(np.int32), spans.data[at])))

    def row(*values) -> pa.RecordBatch:
        values = [*values, *[None] * (len(_OPENED) - len(values))]
        return pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], t) for v, t in zip(values, _OPENED.types)], schema=_OPENED)

    return chunks.join(answers, "chunk", "left").mapInArrow(run, OPENED)


def in_rows(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``counts`` of them."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def counted_bits(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=4), count=int.from_bytes(raw[:4], "little")).astype(bool)


def earlier_twins(suffixes: Suffixes, begins: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Spans that an earlier document of the bucket holds too, found by hash and verified byte by byte."""
    key = suffixes.hashed(begins, size)
    order = np.lexsort((rank, size, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (size[order][1:] != size[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    mine, first = order[rank[order] > rank[first]], first[rank[order] > rank[first]]
    return mine[equal_ranges(suffixes.text, begins[mine], begins[first], size[mine])]


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from a and from b are the same, some ranges at a time."""
    out = [np.zeros(0, dtype=bool)]
    for i in range(0, len(a), _PAIRS):
        n = size[i : i + _PAIRS]
        differs = data[in_rows(a[i : i + _PAIRS], n)] != data[in_rows(b[i : i + _PAIRS], n)]
        out.append(~np.logical_or.reduceat(differs, np.cumsum(n) - n))
    return np.concatenate(out)


def shared(hashes: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def sorted_answers(opened: DataFrame) -> DataFrame:
    """(chunk, sorts): for each sort bucket, the number of strings and a bit each: does an earlier document have it?"""

    def run(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, chunk = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
        for a, b in zip(ends, ends[1:]):
            part = table.slice(a, b - a).combine_chunks()
            sent = [part.column("docs").to_pylist(), *(b"".join(part.column(c).to_pylist()) for c in ("docs", "extra", "places", "data"))]
            n_spans, doc = np.array([len(x) // 4 for x in sent[0]]), np.frombuffer(sent[1], dtype=np.int32)
            extra, place, text = (np.frombuffer(x, dtype=np.uint8) for x in sent[2:])
            rank = np.repeat(np.argsort(np.argsort(chunk[a:b])), n_spans).astype(np.int64) << 32 | doc
            counts, place = extra.astype(np.int64) + 1, place.astype(np.int64)
            size = counts + LENGTH - 1
            begins, ends_ = np.cumsum(size) - size, np.cumsum(counts)
            suffixes = Suffixes(text, LENGTH)
            later = np.zeros(ends_[-1], dtype=bool)
            again = earlier_twins(suffixes, begins, size, rank)
            later[in_rows(ends_[again] - counts[again], counts[again])] = True
            # a string whose hash no other has is equal to none; the suffixes of the others are sorted
            left = np.ones(len(counts), dtype=bool)
            left[again] = False
            left = np.flatnonzero(left)
            at, string = in_rows(begins[left], counts[left]), in_rows(ends_[left] - counts[left], counts[left])
            twin = np.flatnonzero(shared(suffixes.hashed(at, LENGTH)))
            if len(twin):
                span, at, string = np.repeat(left, counts[left])[twin], at[twin], string[twin]
                # strings compare only with those of the same anchor at the same place
                alone = place[span] == NO_ANCHOR
                offset = np.where(alone, -1, place[span] - (at - begins[span]))
                group = np.where(alone, suffixes.hashed(at, LENGTH), suffixes.hashed(np.where(alone, at, begins[span] + place[span]), PIECE))
                by = np.lexsort((offset, group))
                g, o = group[by], offset[by]
                number = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]))
                order, run_of = equal_runs(suffixes, at[by], number)
                ranks = rank[span[by]][order]
                least = np.minimum.reduceat(ranks, np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]])))
                later[string[by[order]]] = ranks > least[run_of]
            cut = np.cumsum(np.add.reduceat(counts, np.cumsum(n_spans) - n_spans))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[a:b]), pa.array(bucket[a:b]), pa.array([len(x).to_bytes(4, "little") + np.packbits(x).tobytes() for x in np.split(later, cut)], pa.binary())], schema=ANSWER)

    sent = opened.where("kind = 1").select("bucket", "chunk", "extra", "places", "docs", "data")
    answers = by_groups(sent, ["bucket"], run, "chunk long, bucket int, bits binary")
    return answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("sorts"))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:int,end:int>>, kept binary"
_INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the byte intervals removed from it and the bytes kept."""
    scratch = scratch or Scratch(spark, "suffixdup")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = text_bytes(rows)
    each = chunk_bytes(n, CHUNK_BYTES)
    chunks = scratch.put("chunks", as_chunks(in_ranges(rows, parts_for(n, 8 * each), ["doc_id"]), each))
    n_spans = max(1024, n // 12)
    anchor_bits, n_buckets = anchor_bits_for(n_spans), max(LEAST_BUCKETS, buckets_for(n_spans, WIDTH, n))
    answers = scratch.put("answers", span_answers(chunks, anchor_bits, n_buckets))
    opened = scratch.put("opened", open_spans(chunks, answers, anchor_bits, n_buckets, parts_for(n, SORT_BYTES, LEAST_BUCKETS)))
    sorts = scratch.put("sorts", sorted_answers(opened))
    state = opened.where("kind = 0").select("chunk", "marks", "first", "last", "copy_to", "copy_from", "copied")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, texts = of_chunk(batch, i)
                column = texts.cast(pa.large_binary())
                values = column.to_pylist()
                n = sum(map(len, values))
                starts = np.unpackbits(np.frombuffer(batch.column("marks")[i].as_py(), dtype=np.uint8), count=n).astype(bool)
                sorts = batch.column("sorts")[i].as_py()
                if sorts:
                    first, last, to, source, copied = (batch.column(c).slice(i, 1).flatten().to_numpy().astype(np.int64) for c in ("first", "last", "copy_to", "copy_from", "copied"))
                    strings = in_rows(first, last - first + 1)
                    starts[strings[np.concatenate([counted_bits(x["bits"]) for x in sorts])]] = True
                    for _ in range(2):  # a span may copy a string that copies another
                        starts[in_rows(to, copied)] |= starts[in_rows(source, copied)]
                yield cut(ids, values, starts)

    def cut(ids: pa.Array, values: list[bytes], starts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(starts)
        change = np.zeros(len(starts) + LENGTH + 1, dtype=np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
        marks = np.cumsum(change)[: len(starts)] > 0
        out, begin = [], 0
        for v in values:
            m = marks[begin : begin + len(v)]
            begin += len(v)
            if m.any():
                a, b = intervals(m)
                out.append((len(v), int(m.sum()), len(a), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], np.frombuffer(v, dtype=np.uint8)[~m].tobytes()))
            else:
                out.append((len(v), 0, 0, [], v))
        kinds = [pa.int64(), pa.int64(), pa.int64(), _INTERVALS, pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return chunks.join(state, "chunk").join(sorts, "chunk", "left").mapInArrow(finish, CUT)
