import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrivana.llm import tokens as T

ENCODER = T.encoder(T.tokenizer_path())
LIBRARY = Tokenizer.from_file(T.tokenizer_path())


def reference(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(texts):
    sizes, ids = ENCODER.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u180e", "\u2003", "\x00", "\x1f", "'s", "don't", "the", "Über", "1", "42", ".", "...", "?!", "é", "日本", "<|endoftext|>", "<|", "|>", "a"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(alphabet=st.characters(codec="utf-8"), max_size=20)), min_size=1, max_size=6))
def test_encoder_matches_the_library(texts):
    assert encoded(texts) == list(map(reference, texts))


def test_control_strings_and_nulls():
    assert encoded(["a <|endoftext|> b", None, ""]) == [[64, 220, 50256, 275], [], []]
    assert encoded(["x " * 3 + "<|endoftext|>" + "y" * 1000]) == [reference("x " * 3 + "<|endoftext|>" + "y" * 1000)]


def test_many_lines_of_pieces(monkeypatch):
    monkeypatch.setattr(T, "IN_LINE", 3)
    texts = [" ".join(f"word{a} {a}x. Ünt\tz" for a in range(k, k + 30)) for k in range(0, 60, 10)]
    assert encoded(texts) == list(map(reference, texts))


def test_a_vocabulary_that_merges_tabs(monkeypatch):
    encoder = T.Encoder(T.tokenizer_path())
    monkeypatch.setattr(encoder, "tab", -1)
    sizes, ids = encoder.encode(pa.array(["one two three", "four. five"]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [reference("one two three"), reference("four. five")]


def test_shards_are_placed_by_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "SUMMED", 3)
    rows = [(i, f"p{i}", 0, i * i + 1, 0) for i in (0, 1, 2, 4, 5, 9, 11)]
    got = {r.path: r.base for r in T.placed(spark.createDataFrame(rows[::-1], T.MANIFEST)).collect()}
    assert got == {f"p{i}": sum(x[3] for x in rows if x[0] < i) for i, *_ in rows}


def brute(rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*reference(t or ""), T.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, clashing, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 4000)
    rng = random.Random(2)
    rows = [(i, None if i % 11 == 0 else " ".join(rng.choice(["the", "Ünt", "x.\n", "", "42"]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(500, "word " * 30_000), (501, "a" * 5000), (8, "again <|endoftext|>"), (8, "again <|endoftext|>"), (8, None), (None, "no id"), (None, "another")]
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    manifest = T.write_sequences(spark, df, length=64)
    assert manifest.count() > 1
    got = sorted((tuple(r) for r in T.read_sequences(spark, manifest).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    shard = max(manifest.collect(), key=lambda r: r.n_tokens)
    sequences, documents = T.open_shard(shard.path)
    ids, mask = T.sequence_at(sequences, 0)
    assert len(ids) == len(mask) == 64 and mask.all() and sequences.schema.field("ids").type.list_size == 64
    last, mask = T.sequence_at(sequences, shard.n_sequences - 1)
    assert mask.sum() == (shard.n_tokens - 1) % 64 + 1 and not last[~mask].any()


def test_empty(spark, docs):
    assert T.token_rows(spark, docs([])).collect() == []
    assert [tuple(r)[:3] for r in T.token_rows(spark, docs([None])).collect()] == [(0, 0, 1)]


def test_every_sequence_is_found_by_division(tmp_path):
    """A shard that is flushed many times: batches are even, and each sequence is where it should be."""
    rng = np.random.default_rng(3)
    writer, whole = T.ShardWriter(str(tmp_path / "shard"), 8, np.uint16, per_batch=4), []
    for k in range(60):
        sizes = rng.integers(1, 40, size=rng.integers(1, 4))
        ids = rng.integers(0, 50_000, size=sizes.sum()).astype(np.uint16)
        writer.add(pa.array(np.arange(len(sizes)) + 10 * k), sizes, ids)
        whole.append(ids)
    whole = np.concatenate(whole)
    n_docs, n_tokens, n_sequences = writer.close()
    assert n_tokens == len(whole) and n_sequences == -(-len(whole) // 8)
    with pa.memory_map(str(tmp_path / "shard" / "sequences.arrow")) as source:
        read = pa.ipc.open_file(source)
        assert [read.get_batch(b).num_rows for b in range(read.num_record_batches - 1)] == [4] * (read.num_record_batches - 1)
        for k in range(n_sequences):
            ids, mask = T.sequence_at(read, k)
            assert (ids[mask] == whole[8 * k : 8 * k + 8]).all() and mask.sum() == min(8, len(whole) - 8 * k)
        for k in (-1, n_sequences):
            with pytest.raises(IndexError):
                T.sequence_at(read, k)
