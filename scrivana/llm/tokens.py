"""Token-ID output: Arrow files of equal-length sequences and masks, read by position without copying.

A shard holds the documents of one range of doc_id, ascending. Its stream of ids (each document followed by the
end id) is cut into sequences of ``length`` ids, stored as fixed-size lists beside a mask that is false on the
padding of the shard's last sequence; a second file says where each document starts. All batches of a file but its
last hold equally many sequences, so sequence k is found by one division, in a memory-mapped buffer.

Nulls count as empty texts; an empty text is its end id alone; rows that repeat a doc_id are all written, side
by side in the order of their texts' first 32 characters, then of a hash; a null doc_id sorts first; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivana.llm.common import Scratch, blocks, filesystem, in_ranges, local_uri, no_nulls, parts_for, text_bytes

END_ID = 2
LENGTH = 2048
SHARD_BYTES = 24 << 20
#: Texts encoded at once.
BLOCK_BYTES = 8 << 20
#: Pieces that go to the library in one line.
IN_LINE = 512

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
#: Units whose splits are plain: letters, then full stops and the like, on one line or several.
PLAIN = rf"^ ?{_LETTER}+[.,;:!?]*(\n{_LETTER}+[.,;:!?]*)*$"
SPLITS = r"([.,;:!?]+|\n)"
_WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A piece that is split between two tabs as it is alone.
JOINS = rf"^ ?[^{_WHITE}]([^\t]*[^{_WHITE}])?$"


class Encoder:
    """Whole texts to ids by the tokenizers library, each distinct piece of a block of texts once.

    The vocabulary's pattern always splits before a space that something other than white space follows, and merges
    never cross a split. So a text's ids are those of its units in a row: its parts between such spaces, each after the
    first with its space. A plain unit falls into pieces the same way: a run of Latin letters with its space, a run of
    full stops and the like, a line end. Any other unit is one piece, and so is a whole text that holds a control string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.tab = self.library("\t")[0]

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts in a row."""
        units, start, codes = self.units(no_nulls(texts))
        flat, ends = self.pieces_of(units)
        distinct = flat.dictionary_encode()
        of_piece, place, sizes = self.ids_of(distinct.dictionary)
        codes_ = place[distinct.indices.to_numpy()]
        before = np.concatenate([[0], np.cumsum(sizes[codes_])])[ends]
        of_unit = pa.LargeListArray.from_arrays(pa.array(before), of_piece.take(pa.array(codes_)).flatten())
        upto = np.concatenate([[0], np.cumsum(np.diff(before)[codes])])
        return np.diff(upto[start]), of_unit.take(pa.array(codes)).flatten().to_numpy()

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct units, where each text's units begin (with the end appended), and all units in order, as numbers."""
        lists = pc.split_pattern(texts, " ")
        start = lists.offsets.to_numpy().astype(np.int64)
        start, parts = start - start[0], lists.flatten()
        glued = pc.or_(pc.equal(pc.binary_length(parts), 0), pc.match_substring_regex(parts, f"^[{_WHITE}]")).to_numpy(zero_copy_only=False).copy()
        for control in self.controls:
            glued |= np.repeat(pc.match_substring(texts, control).to_numpy(zero_copy_only=False), np.diff(start))
        glued[start[:-1]] = False
        if glued.any():
            real = np.flatnonzero(~glued)
            parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(real, len(glued)), pa.int32()), parts), pa.scalar(" ", pa.large_string()))
            start = np.searchsorted(real, start)
        first = np.zeros(len(parts), dtype=bool)
        first[start[:-1]] = True
        led, heads = parts.filter(pa.array(~first)).dictionary_encode(), parts.filter(pa.array(first)).dictionary_encode()
        codes = np.empty(len(parts), dtype=np.int64)
        codes[~first] = led.indices.to_numpy()
        codes[first] = heads.indices.to_numpy().astype(np.int64) + len(led.dictionary)
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        return pa.concat_arrays([pc.binary_join_element_wise(none, led.dictionary, space), heads.dictionary]), start, codes

    def pieces_of(self, units: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units' pieces in order, and where each unit's begin (with the end appended)."""
        plain = pc.match_substring_regex(units, PLAIN)
        split = pc.split_pattern(pc.replace_substring_regex(units.filter(plain), SPLITS, "\x00\\1\x00"), "\x00")
        is_plain = plain.to_numpy(zero_copy_only=False)
        counts = np.ones(len(units), dtype=np.int64)
        counts[is_plain] = np.diff(split.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts)])
        from_plain = np.repeat(is_plain, counts)
        place = np.empty(len(from_plain), dtype=np.int64)
        place[from_plain] = np.arange(from_plain.sum())
        place[~from_plain] = np.arange((~from_plain).sum()) + from_plain.sum()
        return pa.concat_arrays([split.flatten(), units.filter(pc.invert(plain))]).take(pa.array(place)), ends

    def ids_of(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Lists of ids, where each piece's list stands, and the lists' sizes. Most pieces go to the library in lines, with
        tabs between, which are pieces of their own."""
        joins = pc.match_substring_regex(pieces, JOINS)
        for control in self.controls:
            joins = pc.and_(joins, pc.invert(pc.match_substring(pieces, control)))
        some, others = pieces.filter(joins), pieces.filter(pc.invert(joins))
        starts = pa.array([*range(0, len(some), IN_LINE), len(some)] if len(some) else [0], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(starts, some), pa.scalar("\t", pa.large_string())).to_pylist()
        ids, sizes = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        for k, encoded in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            line = np.array(encoded.ids, dtype=self.dtype)
            cuts = np.flatnonzero(line == self.tab)
            n = min(IN_LINE, len(some) - k * IN_LINE)
            if len(cuts) == n - 1:
                ids.append(line[line != self.tab])
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(line)]])) - 1)
            else:  # a vocabulary that merges tabs with other characters
                own = [self.library(x) for x in some.slice(k * IN_LINE, n).to_pylist()]
                ids += own
                sizes.append(np.array(list(map(len, own))))
        own = [self.library(x) for x in others.to_pylist()]
        ids, sizes = np.concatenate([*ids, *own]), np.concatenate([*sizes, np.array(list(map(len, own)), dtype=np.int64)])
        joined, place = joins.to_numpy(zero_copy_only=False), np.empty(len(pieces), dtype=np.int64)
        place[joined], place[~joined] = np.arange(len(some)), len(some) + np.arange(len(others))
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids)), place, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """Writes one shard in batches of equally many sequences; what doesn't fill one waits in memory."""

    def __init__(self, base: str, length: int, dtype, per_batch: int = 256):
        self.base, self.length, self.dtype, self.per_batch = base, length, np.dtype(dtype), per_batch
        self.files, path = filesystem(base)
        self.files.create_dir(path)
        self.path = path
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.files.open_output_stream(f"{path}/sequences.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index_sink = self.files.open_output_stream(f"{path}/documents.arrow")
        self.index = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with so many ids each, all of them in a row."""
        starts = self.n_tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.index.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_docs += len(sizes)
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.per_batch * self.length:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, dtype=self.dtype)])
        whole = len(flat) // self.length
        whole -= 0 if last else whole % self.per_batch
        rest = flat[whole * self.length :]
        flat, real = flat[: whole * self.length], whole * self.length
        if last and len(rest):
            real += len(rest)
            flat = np.concatenate([flat, rest, np.zeros(self.length - len(rest), dtype=self.dtype)])
            rest, whole = rest[:0], whole + 1
        for at in range(0, whole, self.per_batch):
            part = flat[at * self.length : (at + self.per_batch) * self.length]
            mask = np.arange(at * self.length, at * self.length + len(part)) < real
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.n_sequences += whole
        self.held, self.n_held = [rest.copy()], len(rest)

    def close(self) -> tuple[int, int, int]:
        self._flush(last=True)
        self.out.close()
        self.sink.close()
        self.index.close()
        self.index_sink.close()
        return self.n_docs, self.n_tokens, self.n_sequences


def write_sequences(spark: SparkSession, docs: DataFrame, order: Column | None = None, to: str | None = None, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards below ``to`` (default: the shared folder) and returns their manifest, one row each.

    Documents stand in the order of ``order``, then doc_id (ascending doc_id by default).
    A shard's folder has a name of its own for every attempt; the manifest names the attempt that counted.
    """
    scratch = scratch or Scratch(spark, "tokens")
    tokenizer = tokenizer or tokenizer_path()
    to = local_uri(to or f"{scratch.root}/sequences")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([order.alias("place")] if order is not None else []))
    by = ["place", "doc_id"] if order is not None else ["doc_id"]
    n = parts_for(text_bytes(own), SHARD_BYTES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, at = TaskContext.get().partitionId(), None, ""
        enc = encoder(tokenizer)
        for table in blocks(batches, "text", BLOCK_BYTES):
            if writer is None:
                at = f"{to}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
                writer = ShardWriter(at, length, enc.dtype)
            sizes, ids = enc.encode(table.column("text"))
            writer.add(table.column("doc_id").combine_chunks(), sizes + 1, np.insert(ids, np.cumsum(sizes), end_id))
        if writer is not None:
            n_docs, n_tokens, n_sequences = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": at, "n_docs": n_docs, "n_tokens": n_tokens, "n_sequences": n_sequences}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    return scratch.put("manifest", in_ranges(own, n, by).select("doc_id", "text").mapInArrow(write, MANIFEST))


def open_shard(path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """Sequences and document index of a shard, memory-mapped where the file system is local."""
    from pyarrow import fs

    files, at = filesystem(path)
    take = pa.memory_map if isinstance(files, fs.LocalFileSystem) else files.open_input_file
    return pa.ipc.open_file(take(f"{at}/sequences.arrow")), pa.ipc.open_file(take(f"{at}/documents.arrow"))


def shard_ids(sequences: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The ids under the mask, batch by batch; whole sequences are views of the file."""
    for k in range(sequences.num_record_batches):
        batch = sequences.get_batch(k)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        mask = batch.column(1).values
        yield ids if mask.true_count == len(ids) else ids[mask.to_numpy(zero_copy_only=False)]


def sequence_at(sequences: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k. The first batch tells how many sequences a batch holds."""
    if k < 0 or not sequences.num_record_batches:
        raise IndexError(k)
    b, place = divmod(k, sequences.get_batch(0).num_rows)
    if b >= sequences.num_record_batches or place >= (batch := sequences.get_batch(b)).num_rows:
        raise IndexError(k)
    return batch.column(0)[place].values.to_numpy(zero_copy_only=True), batch.column(1)[place].values.to_numpy(zero_copy_only=False)


#: Shards whose sizes are summed in one window.
SUMMED = 2048


def placed(manifest: DataFrame) -> DataFrame:
    """(path, base): each shard with the ids of all shards before it; sums within groups of shards, then over groups."""
    group = F.floor(F.col("shard") / SUMMED).alias("group")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", "n_tokens", group)
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("group")), F.lit(0))
    groups = shards.groupBy("group").agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("group", earlier.alias("earlier"))
    return shards.select("path", "group", within.alias("within")).join(groups, "group").select("path", (F.col("within") + F.col("earlier")).alias("base"))


def read_sequences(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sequences, index = open_shard(path)
                ids, held, at = shard_ids(sequences), np.zeros(0, dtype=np.uint32), 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    sums = []
                    for n in part.column(2).to_pylist():
                        crc = 0
                        while n:
                            if at == len(held):
                                held, at = next(ids), 0
                            took = held[at : at + n]
                            crc = zlib.crc32(took.astype("<u4").tobytes(), crc)
                            at += len(took)
                            n -= len(took)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([part.column(0), pc.add(part.column(1), base), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(manifest).repartition(max(1, manifest.count())).mapInArrow(read, READ_BACK)


def token_rows(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes the files and reads them back: one row for each document."""
    return read_sequences(spark, write_sequences(spark, docs, **options))
