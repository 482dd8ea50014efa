"""The pipeline on a small folder of tables: each stage against what it must keep, and the guard without the subpackage."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrivana.llm import tokens

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    item = " ".join(rng.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(words) for _ in range(60)]
        kind = i % 10
        text = " ".join(w)
        if kind == 0:
            text = " ".join(x + "$$$" for x in w)
        elif kind == 1 and i > 20:
            text = rows[i - 2 if (i - 2) % 10 > 2 else i - 5][1] + " tail"
        elif kind == 2:
            text += " " + item
        rows.append((i, text, "en", f"src{i % 3}", len(text), "extra"))
        if i < 200:
            labels.append((i, int(kind != 0), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r[1] for r in rows}


def test_stages(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
    junk = {i for i in texts if i % 10 == 0}
    assert set(kept["quality"]) == set(texts) - junk
    copies = {i for i in texts if i % 10 == 1 and i > 20}
    assert set(kept["near_duplicates"]) == set(kept["quality"]) - copies
    assert set(kept["decontamination"]) == {i for i in kept["near_duplicates"] if i % 10 != 2}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and len(set(kept["mixing"])) < len(kept["mixing"])
    rows = sorted((tuple(r) for r in corpus_pipeline.token_files(spark, docs, sf_dir).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == kept["mixing"]
    assert [b[1] - a[1] for a, b in zip(rows, rows[1:])] == [r[2] for r in rows[:-1]]
    enc = tokens.encoder(tokens.tokenizer_path())
    assert all(r[2] == len(enc.tokenizer.encode(texts[r[0]], add_special_tokens=False).ids) + 1 for r in rows)


def test_empty_documents(spark, folder, tmp_path):
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_repeated_and_unnamed_rows(spark, docs):
    df = docs({1: "a b c d e f", 2: "a b c d e f", 3: "g h i j k l"})
    df = df.union(df).union(docs({None: "no id at all here then"}))
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()) == [0, 1, 3]


def test_two_texts_of_one_id_both_stay(spark, docs):
    df = docs({1: "a b c d e f", 2: "m n o p q r"}).union(docs({1: "g h i j k l"})).union(docs({1: "G h i j k l"}))
    df = df.withColumn("kept_id", F.lit(1)).withColumn("ITS_TEXT", F.lit("x")).withColumn("component_id", F.lit(0))
    got = corpus_pipeline.one_of_each_group(spark, df, "")
    assert got.columns == df.columns
    texts = sorted((r.doc_id, r.text.lower()) for r in got.collect())
    assert texts == [(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r")]


def test_odd_rows_through_all_stages(spark, folder):
    """Nulls, empty and very long texts, and columns named as the operators' own, through every stage."""
    sf_dir, texts = folder
    extra = [(900, None), (901, ""), (None, texts[3]), (None, texts[4] + " x"), (None, None), (902, " ".join(f"q{i}" for i in range(50_000)))]
    rows = spark.createDataFrame([(i, t, None, None, None, None) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long, node string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").union(rows)
    for name in ("selected", "kept_id", "doc", "mix_copy", "mix_count", "mix_order", "its_text", "place"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        unnamed, docs = docs.where("doc_id is null").count(), stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and docs.where("selected <> 'mine' or mix_copy <> 'mine'").count() == 0
        if name in ("near_duplicates", "decontamination"):  # none of them can be grouped, none holds an item
            assert docs.where("doc_id is null").count() == unnamed
    n = docs.count()
    got = corpus_pipeline.token_files(spark, docs, sf_dir).collect()
    assert len(got) == n and sum(r.doc_id is None for r in got) == docs.where("doc_id is null").count()


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
