"""What the operators of this subpackage share: staged tables, chunks of whole texts, hashed words.

Staged tables are those of ``scrivana.staging``. A stage that needs numpy reads *chunks*: rows that hold many whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivana.staging import Scratch  # noqa: F401


def local_uri(uri: str) -> str:
    """file:/a and file:///a both name /a."""
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def filesystem(uri: str):
    """The file system of a place and its path there, for files that this subpackage reads and writes itself."""
    from pyarrow import fs

    uri = local_uri(uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have; Spark's names don't tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_ranges(rows: DataFrame, n: int, keys: list[str], text: str = "text") -> DataFrame:
    """Rows dealt into ``n`` sorted ranges of the keys. Rows of equal keys stand in the order of their texts' first 32
    characters, then of a hash, and equal rows anyhow; so very many rows of one key, or of none, fill several ranges."""
    ties = {free_name(rows, "_start"): F.left(F.col(text), F.lit(32)), free_name(rows, "_hash"): F.xxhash64(text), free_name(rows, "_at"): F.monotonically_increasing_id()}
    return rows.withColumns(ties).repartitionByRange(n, *keys, *ties).sortWithinPartitions(*keys, *ties).drop(*ties)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: what the number of chunks follows."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return int(row["n"] or 0) + 16 * int(row["rows"])


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(n_bytes) // each))


def no_nulls(texts: pa.ChunkedArray | pa.Array) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def blocks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.Table]:
    """The rows of Arrow batches in groups whose texts stay near ``most_bytes``; a longer text gets its own group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += int(n) + 16
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of several texts, white space being 0x20 and 0x09-0x0D.

    ids: a number for each word in order; start: where each text's words begin, with the end appended;
    lexicon: the distinct words as UTF-8 bytes, by id.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = no_nulls(texts)
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        ends -= ends[0] if len(ends) else 0
        self.lexicon = coded.dictionary.cast(pa.large_binary())
        empty = pc.index(self.lexicon, b"").as_py()
        if empty >= 0:
            real = ids != empty
            before = np.concatenate([[0], np.cumsum(real)])
            ids, ends = ids[real], before[ends]
        self.ids, self.start = ids, ends

    def hashed(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit values for each word, from a 128-bit hash of its bytes."""
        raw = b"".join(xxhash.xxh3_128_digest(w, seed) for w in self.lexicon.to_pylist())
        pair = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
        return pair[self.ids, 0], pair[self.ids, 1]


def windows(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp values, modulo 2**64, of every run of ``width`` values (already well mixed)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up = powers(base, len(values))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    down = powers(pow(base, -1, 1 << 64), n)
    return mix64((prefix[width:] - prefix[:-width]) * down)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by whole-number keys, each with where its groups begin and end."""
    held: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            changed |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(changed) + 1, [table.num_rows]])

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[0], 0) == key(batch, batch.num_rows - 1):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        ends = cuts(table)
        if len(ends) > 2:
            yield table.slice(0, int(ends[-2])), ends[:-1]
        rest = table.slice(int(ends[-2])).combine_chunks()
        held = rest.to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cuts(table)


def by_groups(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(table, ends) on whole groups; many small groups share one call."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_groups(batches, keys):
            yield from run(table, ends)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)
