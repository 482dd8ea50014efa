"""Substring dedup by fixed-length token windows.

Every window of ``width`` words gets Rabin-Karp values over the hashes of its words; a window that starts anywhere
else too (another document, or the same one) marks all of its words, and marked words form maximal intervals.
Windows are judged on the input, not on what is left, so each of several copies goes.

Words are runs of characters other than 0x20 and 0x09-0x0D. Null and empty texts have no words and keep the empty
text; a text shorter than a window keeps all its words; rows that repeat a doc_id are documents of their own, so
they repeat one another's windows; an empty table gives an empty table; other columns are not read.

The values have 128 bits to start from; as many bytes are exchanged as make a false match unlikely at the input's
size, 16 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.chunks import CHUNK_BYTES, Distinct, answered, as_chunks, buckets_for, chunk_bytes, entry_bytes, of_chunk, repeated_elsewhere
from scrivana.llm.common import Scratch, Words, text_bytes, windows

WIDTH = 35
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class ChunkWindows:
    """Words and windows of the texts of one chunk; a window never crosses texts."""

    def __init__(self, texts: pa.Array, width: int):
        self.words, self.width = Words(texts), width
        start = self.words.start
        counts = np.maximum(np.diff(start) - width + 1, 0)
        ends = np.cumsum(counts)
        self.at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[:-1] - (ends - counts), counts)

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.words.hashed()
        return windows(one, self.width, BASES[0])[self.at], windows(two, self.width, BASES[1])[self.at]

    def marked(self, repeated: np.ndarray) -> np.ndarray:
        """Words under a repeated window."""
        change = np.zeros(len(self.words.ids) + 1, dtype=np.int64)
        at = self.at[repeated]
        np.add.at(change, at, 1)
        np.add.at(change, at + self.width, -1)
        return np.cumsum(change[:-1]) > 0


REMOVED = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
_INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def intervals(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def remove_repeated(spark: SparkSession, docs: DataFrame, width: int = WIDTH, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the word intervals removed from it and the words kept, joined by one space."""
    scratch = scratch or Scratch(spark, "windowdup")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = text_bytes(rows)
    n_windows = n // 4  # a word and its space are hardly shorter
    size = entry_bytes(n_windows)
    n_buckets = buckets_for(n_windows, size, n)
    chunks = scratch.put("chunks", as_chunks(rows, chunk_bytes(n, CHUNK_BYTES)))
    answers = scratch.put("answers", repeated_elsewhere(chunks, lambda texts: ChunkWindows(texts, width).values(), size, n_buckets))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, texts = of_chunk(batch, i)
                own = ChunkWindows(texts, width)
                found = Distinct(*own.values(), size)
                again = answered(found, batch.column(3)[i].as_py(), n_buckets) | (found.times > 1)
                yield cut(ids, own.words, own.marked(again[found.place]))

    def cut(ids: pa.Array, words: Words, marks: np.ndarray) -> pa.RecordBatch:
        lexicon = np.array(words.lexicon.to_pylist() + [b""], dtype=object)[:-1]
        n_words = np.diff(words.start)
        removed, kept, n_removed = [], [], []
        for a, b in zip(words.start, words.start[1:]):
            m = marks[a:b]
            n = int(m.sum())
            n_removed.append(n)
            removed.append([{"start": x, "end": y} for x, y in zip(*(z.tolist() for z in intervals(m)))] if n else [])
            kept.append(b" ".join(lexicon[words.ids[a:b][~m] if n else words.ids[a:b]]))
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, _INTERVALS), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return chunks.join(answers, "chunk", "left").mapInArrow(finish, REMOVED)
