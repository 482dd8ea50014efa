"""Folders that are pruned before they are opened, and vintages that are there whole or not at all."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import scrivana
from scrivana.sources import vintages as V


@pytest.fixture
def shipped(spark):
    scrivana.ship(spark)
    return spark


def corpus(spark, at, name, n=6, text="text é"):
    rows = spark.range(n).select(F.concat(F.lit(name), F.lit("_"), "id").alias("stem"), F.lit(text).alias("text"))
    V.write_vintage(V.files_of(rows, F.concat(F.lit("transcripts/"), "stem", F.lit(".md")), F.col("text")).union(V.lines_of(rows, "manifest")), f"{at}/{name}")


def test_filters_prune_folders_before_a_file_is_opened(shipped, tmp_path, monkeypatch):
    for name in ("a", "b", "c", "d"):
        corpus(shipped, tmp_path, name)
    (tmp_path / "matrix.jsonl").write_text("".join(json.dumps({"corpus": c, "family": f, "severity": "light"}) + "\n" for c, f in (("a", "scan"), ("b", "photo"), ("c", "scan"))))
    os.symlink(tmp_path / "a", tmp_path / "z")  # the same folder again
    whole = V.folder_texts(shipped, str(tmp_path))
    assert sorted({(r.corpus, r.family, r.severity) for r in whole.collect()}, key=str) == [("a", "scan", "light"), ("b", "photo", "light"), ("c", "scan", "light"), ("d", None, None)]
    assert whole.count() == 24 and {r.text for r in whole.collect()} == {"text é"} and whole.where("corpus = 'z'").count() == 0
    for name in ("b", "d"):  # whoever opens these fails
        os.symlink("/nowhere/at/all", tmp_path / name / "transcripts" / "gone.md")
        (tmp_path / name / "transcripts" / "bad.md").write_bytes(b"\xff")
    few = whole.where(F.col("corpus").isin("a", "c") & F.col("stem").endswith("_1"))
    assert sorted(r.stem for r in few.collect()) == ["a_1", "c_1"] and few.rdd.getNumPartitions() == 2
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan corpus_folders" in plan and "EndsWith(stem" in plan and "isin" not in plan.lower() and "corpus#" in plan and "corpus IN" not in plan
    assert whole.where("family = 'scan' and severity = 'light'").count() == 12 and whole.where("corpus like 'a%'").count() == 6
    assert whole.where("family <=> 'scan' and corpus = 'b'").count() == 0 and whole.where("corpus = 'none'").count() == 0
    with pytest.raises(Exception, match="utf-8|gone"):
        whole.where("corpus = 'd'").count()
    reader = V.FolderReader({"path": str(tmp_path)})
    opened = []
    monkeypatch.setattr(V.FolderReader, "index", lambda self, files, base: opened.append("index") or {"a": ("scan", None)})
    assert list(reader.pushFilters([V.EqualTo(("family",), "scan"), V.In(("stem",), ("x",))])) == [V.In(("stem",), ("x",))]
    parts = reader.partitions()
    assert opened == ["index"] and [p.labels for p in parts] == [(None, "a", "scan", None)] and len(parts[0].paths) == 6


def test_predictions_and_long_listings(shipped, tmp_path, monkeypatch):
    for model, name, n in (("m1", "a", 5), ("m1", "b", 2), ("m2", "a", 3)):
        (tmp_path / model / name).mkdir(parents=True)
        for i in range(n):
            (tmp_path / model / name / f"p{i}.md").write_text(f"{model} {name} {i}")
        (tmp_path / model / name / "run.json").write_text("{}")
    read = V.folder_texts(shipped, f"file:{tmp_path}", "predictions").where("model = 'm1'")
    assert sorted((r.model, r.corpus, r.stem, r.text) for r in read.collect()) == sorted(("m1", c, f"p{i}", f"m1 {c} {i}") for c, n in (("a", 5), ("b", 2)) for i in range(n))
    monkeypatch.setattr(V, "TASK_FILES", 2)
    assert sorted(len(p.paths) for p in V.FolderReader({"path": str(tmp_path), "kind": "predictions"}).partitions()) == [1, 1, 2, 2, 2, 2]
    assert V.folder_texts(shipped, str(tmp_path), committed="true").count() == 0
    with pytest.raises(Exception, match="expected corpora or predictions"):
        V.folder_texts(shipped, str(tmp_path), "other").count()


def test_failed_vintage_leaves_nothing(shipped, tmp_path):
    rows = shipped.range(40).select(F.concat(F.lit("t/"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("midway"))).otherwise("x").alias("content"), F.lit(False).alias("line"))
    with pytest.raises(Exception, match="midway"):
        V.write_vintage(rows.repartition(4), str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    V.write_vintage(rows.where("path <> 't/37'"), str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out" / "t")) == 39 and json.loads((tmp_path / "out" / V.MARKER).read_text()) == {"files": 39, "bytes": 39}
    with pytest.raises(Exception, match="never overwritten"):
        V.write_vintage(rows.limit(1), str(tmp_path / "out"))
    for bad in ("../x", "/x"):
        with pytest.raises(Exception, match="leaves the vintage"):
            V.write_vintage(shipped.createDataFrame([(bad, "", False)], "path string, content string, line boolean"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="named twice"):
        V.write_vintage(rows.where("path = 't/1'").union(rows.where("path = 't/1'")), str(tmp_path / "bad"))
    V.write_vintage(rows.where("path = 'none'"), str(tmp_path / "empty"))
    assert os.listdir(tmp_path / "empty") == [V.MARKER] and sorted(os.listdir(tmp_path)) == ["empty", "out"]


RETRY = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import scrivana
from scrivana.sources import vintages as V
scrivana.ship(spark)

@F.udf("string")
def said(n):
    if n == 29 and not os.path.exists({mark!r}):
        open({mark!r}, "w").close()
        os._exit(1)  # the worker dies after it has written most of its files
    return f"text {{n}}"

rows = spark.range(0, 60, 1, 2).select(F.col("id").cast("string").alias("stem"), said("id").alias("text"))
V.write_vintage(V.files_of(rows, F.concat(F.lit("t/"), "stem"), F.col("text")).union(V.lines_of(rows.select("stem"), "lines")), {out!r})
"""


def test_killed_task_is_repeated_without_strays(tmp_path):
    out, mark = tmp_path / "o" / "v", tmp_path / "died"
    out.parent.mkdir()
    code = RETRY.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), mark=str(mark), out=str(out))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert mark.exists() and os.listdir(out.parent) == ["v"] and sorted(os.listdir(out)) == [V.MARKER, "lines", "t"]
    assert {f: (out / "t" / f).read_text() for f in os.listdir(out / "t")} == {str(n): f"text {n}" for n in range(60)}
    lines = sorted(json.loads(x)["stem"] for f in os.listdir(out / "lines") for x in (out / "lines" / f).read_text().splitlines())
    assert lines == sorted(str(n) for n in range(60))
