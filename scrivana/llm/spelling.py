"""Spelling variants: words one edit apart, found by their halves with Aho-Corasick automata.

Every word is cut into two segments. An edit spoils one of them, so of two words that differ by one inserted, deleted or
replaced character each holds a segment of the other: the first one at its start, or the second one at its end. Shards
of an automaton hold the segments of all words; all words are scanned by the shards whose words are as long as they are
to within one character and share the two characters at the segment's outer end. A hit counts where the offset and the
lengths fit; then the rest of both words is compared.

A shard holds at most some ``SHARD`` segments and scans some ``4 * SHARD`` words: where more words share their length
and their end, segments and scanned words are dealt into a grid of shards. Counts of words are summed in each task
first. A word comes out of a shard as one row: how many near words there, and the best of them.

Words are maximal runs of letters of a document's whole text, lower-cased only in A-Z, of at least ``least_length``
characters and with at least ``least_count`` occurrences over all documents. ``spoil`` plants misspellings by a hash of
document and run, as a check of the whole. Null and empty texts have no words; a row without an id counts with an empty
id; rows that repeat an id are read one by one; rows that repeat a text count as often as they stand. Equally frequent
near words: the smallest in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch, blocks, no_nulls

#: Letters of a word; lower-cased text. All of them are one byte in Latin-1.
LETTERS = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many documents loses a character.
SPOILED = 97
HELD_WORDS = 300_000
BLOCK_BYTES = 8 << 20
SHARD = 50_000
#: Pairs whose rests are compared at a time.
COMPARED = 1 << 20


def word_counts(docs: DataFrame, key: str, text: str, spoil: int, least_length: int) -> DataFrame:
    """word and n, summed within a task as far as memory goes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for table in blocks(batches, "text", BLOCK_BYTES):
            ids = table.column("id").to_pylist()
            for own, lowered in zip(ids, pc.ascii_lower(no_nulls(table.column("text")))):
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                for word, n in Counter(LETTERS.findall(lowered.as_py())).items():
                    if len(word) < least_length:
                        continue
                    if spoil:
                        h = zlib.crc32(word.encode(), start)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    own = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(read, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shards(words: DataFrame, n_words: int) -> DataFrame:
    """Segments (side 0) and words to scan (side 1), by kind (0: first segments, 1: second ones), length of the segments'
    words, outer end, and place in the grid of shards. words: (word, n)."""
    size = F.length("word")
    segments = words.select("word", "n", size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    end = F.when(F.col("kind") == 0, F.left("word", F.lit(2))).otherwise(F.right("word", F.lit(2)))
    segments = segments.withColumn("end", end)
    # at most n_words / SHARD * 2 groups are so large
    large = segments.groupBy("kind", "size", "end").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > SHARD)
    large = large.select("kind", "size", "end", F.ceil(F.col("held") / SHARD).alias("tall"), F.ceil(F.col("held") / (4 * SHARD)).alias("wide"))
    large = F.broadcast(large) if n_words < 250_000 * SHARD else large

    def gridded(rows: DataFrame) -> DataFrame:
        return rows.join(large, ["kind", "size", "end"], "left").withColumns({"tall": F.coalesce("tall", F.lit(1)), "wide": F.coalesce("wide", F.lit(1))})

    of_segment = F.pmod(F.xxhash64(F.col("word"), F.lit(1)), F.col("tall"))
    of_word = F.pmod(F.xxhash64(F.col("word"), F.lit(2)), F.col("wide"))
    every = {"tall": F.explode(F.sequence(F.lit(0).cast("long"), F.col("tall") - 1)), "wide": F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1))}
    scanned = segments.select("word", "n", "kind", "end", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    common = ["kind", "size", "end"]
    left = gridded(segments).select(*common, of_segment.alias("row"), every["wide"].alias("column"), F.lit(0).alias("side"), "word", "n")
    right = gridded(scanned).select(*common, every["tall"].alias("row"), of_word.alias("column"), F.lit(1).alias("side"), "word", "n")
    return left.unionByName(right)


def letters(words: list[str]) -> np.ndarray:
    """One row a place, one column a word; words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1).T.copy()


def one_edit(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of a's column i and b's column j differ by exactly one edit; b may have a row more, or less."""
    if len(a) > len(b):
        a, b, i, j = b, a, j, i
    if len(a) == len(b):
        differing = np.zeros(len(i), dtype=np.uint8)
        for x, y in zip(a, b):
            differing = np.minimum(differing + (x[i] != y[j]), 2)
        return differing == 1
    before, after = np.ones(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
    for k, x in enumerate(a):
        x = x[i]
        after = (before | after) & (x == b[k + 1][j])
        before &= x == b[k][j]
    return before | after


class Automaton:
    """The segments of one shard: first (kind 0) or second (kind 1) ones of words of one length."""

    def __init__(self, kind: int, size: int, words: list[str], counts: list[int]):
        import ahocorasick

        order = sorted(range(len(words)), key=words.__getitem__)
        self.kind, self.size, self.half = kind, size, size // 2
        self.words, self.counts = [words[k] for k in order], np.array([counts[k] for k in order], dtype=np.int64)
        self.table = letters(self.words)
        groups: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            groups.setdefault(w[self.half :] if kind else w[: self.half], []).append(k)
        self.members = [np.array(g) for g in groups.values()]
        self.found = ahocorasick.Automaton()
        for number, segment in enumerate(groups):
            self.found.add_word(segment, number)
        self.found.make_automaton()

    def scan(self, words: list[str]) -> Iterator[tuple[str, int, int, str]]:
        """Of each word near to others: itself, how many, the count of the best of them, and that one."""
        for size in (self.size - 1, self.size, self.size + 1):
            own = [w for w in words if len(w) == size]
            ends_at = size - 1 if self.kind else self.half - 1
            hits = [(k, number) for k, w in enumerate(own) for end, number in self.found.iter(w) if end == ends_at]
            if hits:
                yield from self._verified(own, size, np.array([h[0] for h in hits]), [self.members[h[1]] for h in hits])

    def _verified(self, own: list[str], size: int, places: np.ndarray, groups: list[np.ndarray]) -> Iterator[tuple[str, int, int, str]]:
        table, many = letters(own), np.array([len(g) for g in groups])
        steps = np.searchsorted(np.cumsum(many), np.arange(COMPARED, int(many.sum()) + COMPARED, COMPARED)) + 1
        start = 0
        for stop in np.unique(np.minimum(steps, len(groups))):
            if stop <= start:
                continue
            i, j = np.concatenate(groups[start:stop]), np.repeat(places[start:stop], many[start:stop])
            start = int(stop)
            if self.kind:  # words that share their first segment as well are met by the shards of first segments
                rest = size - (self.size - self.half)
                near = one_edit(self.table[: self.half], table[:rest], i, j)
                i, j = i[near], j[near]
                same = np.ones(len(i), dtype=bool)
                for k in range(min(self.half, size)):
                    same &= self.table[k][i] == table[k][j]
                i, j = i[~same], j[~same]
            else:
                near = one_edit(self.table[self.half :], table[self.half :], i, j)
                i, j = i[near], j[near]
            order = np.lexsort((i, -self.counts[i], j))
            i, j = i[order], j[order]
            firsts = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else []
            for first, n in zip(firsts, np.diff([*firsts, len(j)])):
                yield own[j[first]], int(n), int(self.counts[i[first]]), self.words[i[first]]


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
SHARD_KEYS = ["kind", "size", "end", "row", "column"]


def scan_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, segments before words: an automaton is held, words pass by."""
    now, segments, automaton = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in [*SHARD_KEYS, "side"])))
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        found: list[tuple[str, int, int, str]] = []
        for a, b in zip(cuts, cuts[1:]):
            *shard, side = keys[a]
            if shard != now:
                now, segments, automaton = shard, [], None
            if side == 0:
                segments += zip(words[a:b], counts[a:b])
            elif segments:
                automaton = automaton or Automaton(shard[0], shard[1], *map(list, zip(*segments)))
                found += automaton.scan(words[a:b])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), NEAR.types)], schema=NEAR)


def near_words(words: DataFrame, n_words: int) -> DataFrame:
    """word, n_near, best_n and best of every word with a near one. words: (word, n), each word once."""
    dealt = shards(words, n_words).repartition(*SHARD_KEYS).sortWithinPartitions(*SHARD_KEYS, "side")
    found = dealt.mapInArrow(scan_shards, "word string, n_near long, best_n long, best string")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """word and root: where following the forms ends. forms: (word, form), each word once, without cycles.

    Every round doubles how far a word sees, on written tables.
    """
    now = scratch.put("roots-0", forms.select("word", F.col("form").alias("root")))
    for i in range(1, most_rounds + 1):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        seen = scratch.put(f"roots-{i}", now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        scratch.drop(f"roots-{i - 1}")
        now = seen.select("word", "root")
        if seen.where("moved").isEmpty():
            return now
    raise RuntimeError("the forms didn't end")


def spelling_variants(spark: SparkSession, docs: DataFrame, spoil: int = 0, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, scratch: Scratch | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    form: the near word with the largest n, if that is at least twice the word's own; root: the last of the forms.
    """
    scratch = scratch or Scratch(spark, "spelling")
    words = scratch.put("words", word_counts(docs, key, text, spoil, least_length).where(F.col("n") >= least_count))
    near = scratch.put("near", words.join(near_words(words, words.count()), "word", "left").withColumn("often", F.col("best_n") >= 2 * F.col("n")))
    ends = roots(near.where("often").select("word", F.col("best").alias("form")), scratch)
    return near.join(ends, "word", "left").select(
        "word",
        F.when(F.col("often"), F.col("best")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("often"), F.col("best_n")).alias("form_n"),
    )
