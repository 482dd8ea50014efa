"""Suffix-array and window dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivana.llm import chunks, suffixdup, windowdup
from scrivana.llm.common import Scratch, in_ranges
from scrivana.llm.suffixes import Suffixes, equal_runs, sort_within


def by_bytes(rows, length=50):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b, own = (t or "").encode(), []
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            own.append(w)
            if w in seen:
                gone[s : s + length] = [True] * length
        seen.update(own)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def by_words(rows, width=35):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = {}
    for _, w in words:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            count[k] = count.get(k, 0) + 1
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def bytes_of(spark, df):
    got = suffixdup.remove_repeated_bytes(spark, df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(tuple(r) for r in got.collect())


def words_of(spark, df):
    return sorted(tuple(r) for r in windowdup.remove_repeated(spark, df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


def pieces(rng, n):
    base = ["".join(rng.choice("ab é\n") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 6)):
            b, a = rng.choice(base), rng.randint(0, 250)
            t += b[a : a + rng.randint(5, 160)]
        rows.append((i, None if i % 31 == 0 else "" if i % 29 == 0 else "a" * rng.randint(0, 200) if i % 17 == 0 else t))
    return rows + rows[3:5] + [(1000, rows[7][1]), (1000, rows[8][1])]


@pytest.mark.parametrize("many", [4096, 3])
def test_bytes(spark, docs, clashing, monkeypatch, many):
    monkeypatch.setattr(suffixdup, "MANY_SPANS", many)
    monkeypatch.setattr(suffixdup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(suffixdup, "SORT_BYTES", 1500)
    rows = pieces(random.Random(many), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bytes_of(spark, clashing(df)) == by_bytes(rows)


def test_spans_of_one_anchor(spark):
    """Many documents around one line of 40 bytes: no 50 bytes repeat, so nothing may be cut."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    line = "".join(rng.choices(letters, k=40))
    rows = [(i, "".join(rng.choices(letters, k=35)) + line + "".join(rng.choices(letters, k=35))) for i in range(110_000)]
    got = suffixdup.remove_repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert got.agg(F.count(F.lit(1)), F.sum("n_bytes"), F.sum("n_removed")).first()[:] == (110_000, 110 * 110_000, 0)


def test_spans_of_one_hash(spark, monkeypatch):
    """With a hash that calls all spans equal, bytes and the sort still tell them apart."""

    class Alike(suffixdup.Spans):
        def values(self, anchor_bits):
            return np.zeros(len(self.first), dtype=np.uint64), np.zeros(len(self.first), dtype=np.uint64)

    monkeypatch.setattr(suffixdup, "Spans", Alike)
    for chunk_bytes in (4000, 1 << 20):
        monkeypatch.setattr(suffixdup, "CHUNK_BYTES", chunk_bytes)
        rows = pieces(random.Random(5), 90)
        assert bytes_of(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == by_bytes(rows)


def test_line_in_every_document(spark, monkeypatch):
    """A string that all documents hold is sent once a chunk, not once an occurrence."""
    rng = random.Random(13)
    line = "".join(rng.choices("abcdefghijklmnop", k=60))
    rows = [(i, "".join(rng.choices("qrstuvwxyz", k=60)) + line + "".join(rng.choices("qrstuvwxyz", k=60))) for i in range(2000)]
    monkeypatch.setattr(suffixdup, "MANY_SPANS", 100)
    monkeypatch.setattr(suffixdup, "CHUNK_BYTES", 100_000)
    held = {}
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, name, df: held.setdefault(name, put(self, name, df)))
    assert bytes_of(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == by_bytes(rows)
    sent = Counter()
    for r in held["opened"].where("kind = 1").collect():
        for k, p in enumerate(r.places):
            if p == suffixdup.NO_ANCHOR:  # strings by themselves have 50 bytes, spans as many as their starts need
                at = sum(r.extra[:k]) + 50 * k
                sent[r.chunk, r.data[at : at + 50]] += 1
    assert sent and set(sent.values()) == {1}
    assert sum(n for _, n in Counter(s for _, s in sent).items() if n > 1) > 11


def test_words(spark, clashing, monkeypatch):
    rng = random.Random(9)
    base = [[rng.choice(["a", "b", "ç", "d,"]) + str(rng.randint(0, 30)) for _ in range(200)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 150)
            w += b[a : a + rng.randint(10, 80)]
        rows.append((i, None if i % 13 == 0 else rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(60, "x " * 90), (61, " \t "), (62, "y\x1cz " * 20), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert words_of(spark, clashing(df)) == by_words(rows)


def test_rows_without_an_id(spark, docs):
    """A null id counts as the smallest, and rows of one id have some order."""
    rng = random.Random(14)
    said = "".join(rng.choices("abcdef ", k=400))
    rows = [(None, said), (None, said + "x"), (3, said[:200]), (3, None), (4, said), (4, said)]
    got = suffixdup.remove_repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in got.collect())
    assert got[2:] == [(3, 0, 0), (3, 200, 200), (4, 400, 400), (4, 400, 400)]
    assert got[:2] in ([(-1, 400, 0), (-1, 401, 400)], [(-1, 400, 400), (-1, 401, 0)])


def test_many_rows_of_one_id_fill_several_ranges(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of all rows, again and again").alias("text"))
    sizes = in_ranges(rows, 8, ["doc_id"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 1500
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words), (None, words), (1, words.replace("w49", "x")), (2, "alone " * 10)]
    got = windowdup.remove_repeated(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in got.collect()) == [(-1, 50), (-1, 50), (1, 49), (2, 0)]


def test_empty_tables(spark, docs):
    assert bytes_of(spark, docs([])) == [] == words_of(spark, docs([]))


def test_long_text(spark, docs):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(0, long), (1, long[500_000:1_500_000] + "!"), (2, "short")]
    got = dict((r[0], r[2]) for r in bytes_of(spark, docs(dict(rows))))
    assert got == {0: 0, 1: 1_000_000, 2: 0}
    n = {r[0]: r[2] for r in words_of(spark, docs(dict(rows)))}
    assert n[2] == 0 and n[0] == n[1] > 0


def test_anchors_fill_buckets_evenly():
    rng = random.Random(2)
    spans = suffixdup.Spans(pa.array(["".join(rng.choices("abcdefghijklmnop ", k=60_000))]))
    counts = np.bincount(chunks.bucket_of(spans.values(36)[0], 16), minlength=16)
    assert len(spans.first) > 3000 and counts.max() < 1.3 * counts.mean()


def test_chunks_and_buckets_grow_with_the_input():
    """The check's sizes are steady; at 100 TB a block between chunk and bucket still holds several values."""
    assert {chunks.chunk_bytes(n, 4 << 20) for n in (0, 10**8, 3 * 10**10)} == {4 << 20}
    assert chunks.buckets_for(10**8, 10, 4 * 10**8) == -(-(10**9) // chunks.BUCKET_BYTES)
    n = 10**14
    values = chunks.chunk_bytes(n, 4 << 20) / 6 / chunks.buckets_for(n // 4, 10, n)
    assert values > 4 and chunks.chunk_bytes(n, 4 << 20) == chunks.LARGEST_CHUNK


def test_suffix_sort():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.permutation(380)[:200]
    group = np.sort(rng.integers(0, 4, 200))
    suffixes = Suffixes(text, 12)
    order = sort_within(suffixes, at, group)
    want = sorted(range(200), key=lambda k: (group[k], text[at[k] : at[k] + 12].tobytes()))
    keys = [(group[k], text[at[k] : at[k] + 12].tobytes()) for k in order]
    assert keys == [(group[k], text[at[k] : at[k] + 12].tobytes()) for k in want]
    order, run = equal_runs(suffixes, at, group)
    keys = [(group[k], text[at[k] : at[k] + 12].tobytes()) for k in order]
    assert len(set(keys)) == run[-1] + 1 and all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], run, run[1:]))


def test_false_hash_matches_are_found(monkeypatch):
    """With a hash that calls everything equal, verification by bytes still sorts right."""
    text = np.frombuffer(b"abcabdabcxbd", dtype=np.uint8)
    suffixes = Suffixes(text, 3)
    monkeypatch.setattr(suffixes, "hashed", lambda at, length: np.zeros(len(at), dtype=np.uint64))
    at, group = np.array([0, 3, 6, 9]), np.zeros(4, dtype=np.int64)
    order, run = equal_runs(suffixes, at, group)
    strings = [text[at[k] : at[k] + 3].tobytes() for k in order]
    assert strings == [b"abc", b"abc", b"abd", b"xbd"] and run.tolist() == [0, 0, 1, 2]
