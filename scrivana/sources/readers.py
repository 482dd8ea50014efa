"""Typed readers and writers of the corpus formats. All of them are Spark sources, so paths may be in any store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivana.sources.config import ground_truth

ENTRIES = "case_id string, layout string, fields map<string,string>"
_SPANS = "array<struct<text:string,poly:array<int>>>"
EVENTS = f"""case_id string, doc_type string, layout_id string, image_file string, events array<struct<
    seq:int, kind:string, text:string,
    meta:struct<label:string,value:string,columns:array<string>,row:int,col:int,column_key:string,header:boolean,colspan:int,rowspan:int,group_header:boolean>,
    spans:{_SPANS}, category_type:string, `order`:int, poly:array<int>>>"""
MANIFEST = "image string, transcript string, doc_type string, sha256 string, pixels_sha256 string, transcript_sha256 string, family string, severity string, layout string, tables string"
MATRIX = "corpus string, family string, severity string, pages int, doc_types array<string>, manifest_sha256 string"
POOLED = "corpus string, image string, transcript string, case_id string, doc_type string, family string, severity string"
SCORED = """model string, corpus string, case_id string, doc_type string, family string, severity string, ref_chars int, pred_chars int,
    prediction_present boolean, verified boolean, strict_edit_distance int, strict_cer double, normalised_edit_distance int,
    normalised_cer double, normalised_wer double, degenerate boolean, table_cell_error_rate double, table_cells_compared int,
    table_cells_correct int, table_cells_misplaced int, table_rows_missing int, table_rows_spurious int, table_count_ref int, table_count_pred int"""
RUN = "model_id string, model_revision string, prompt_sha256 string, corpus string, corpus_manifest_sha256 string, generated_at string, host string"
TIMING = "system string, cards int, shard int, shards int, includes_model_load boolean, images int, inference_seconds double, images_per_minute double"


def entries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Authored entries of every document type (type -> YAML path)."""
    rows = [{**e, "doc_type": doc_type} for doc_type, path in paths.items() for e in ground_truth(path)]
    return spark.createDataFrame(rows, f"{ENTRIES}, doc_type string")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One record a line; a line that is no record fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def page_events(records: DataFrame) -> DataFrame:
    """One row an event, its meta fields as columns."""
    return records.select("case_id", "doc_type", "layout_id", F.explode("events").alias("e")).select("case_id", "doc_type", "layout_id", "e.*").select("*", "meta.*").drop("meta")


def stem_of(path):
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a corpus, with stem and the file's own hash."""
    whole = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("manifest_sha256"))
    return json_lines(spark, path, MANIFEST).withColumn("stem", stem_of("transcript")).join(F.broadcast(whole.limit(1)))


def _below(path, depth: int):
    """The folder ``depth`` steps above a file."""
    return F.element_at(F.split(path, "/"), -1 - depth)


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """Pages of all corpora below a folder: each corpus is a folder with a manifest.jsonl, whose own hash they carry."""
    files = {"recursiveFileLookup": True, "pathGlobFilter": "manifest.jsonl"}
    hashes = spark.read.format("binaryFile").options(**files).load(base).select(_below(F.col("path"), 1).alias("corpus"), F.sha2("content", 256).alias("manifest_sha256"))
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").options(**files).json(base).withColumn("corpus", _below(F.input_file_name(), 1))
    return rows.withColumn("stem", stem_of("transcript")).join(hashes, "corpus")


def prompt_hashes(spark: SparkSession, base: str) -> DataFrame:
    """(corpus, prompt_sha256) of the prompt that each corpus ships."""
    read = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="prompt.md").load(base)
    return read.select(_below(F.col("path"), 1).alias("corpus"), F.sha2("content", 256).alias("prompt_sha256"))


def corpus_texts(spark: SparkSession, base: str) -> DataFrame:
    """(corpus, stem, text) of the transcripts below each corpus's own folder of them."""
    read = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    at = F.input_file_name()
    return read.where(_below(at, 1) == "transcripts").select(_below(at, 2).alias("corpus"), stem_of(at).alias("stem"), F.col("value").alias("text"))


def image_faults(spark: SparkSession, base: str, pages: DataFrame) -> DataFrame:
    """(corpus, stem, fault) of pages whose image is missing or has other bytes than stated."""
    read = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.{png,jpg,jpeg}").load(base)
    found = read.where(_below(F.col("path"), 1) == "images").select(_below(F.col("path"), 2).alias("corpus"), stem_of("path").alias("_image"), F.sha2("content", 256).alias("_found"))
    stated = pages.select("corpus", "stem", stem_of("image").alias("_image"), "sha256")
    both = stated.join(found, ["corpus", "_image"], "left").where(~F.col("sha256").eqNullSafe(F.col("_found")))
    return both.select("corpus", "stem", F.when(F.col("_found").isNull(), "missing").otherwise("hash").alias("fault"))


def runs(spark: SparkSession, base: str) -> DataFrame:
    """(model, corpus, ...) of every run record below ``<model>/<corpus>/``; model and corpus are the folders' names."""
    read = spark.read.schema(RUN).option("multiLine", True).option("mode", "FAILFAST").options(recursiveFileLookup=True, pathGlobFilter="run.json").json(base)
    at = F.input_file_name()
    return read.select(_below(at, 2).alias("model"), _below(at, 1).alias("corpus"), "prompt_sha256", "corpus_manifest_sha256")


def predicted_texts(spark: SparkSession, base: str) -> DataFrame:
    """(model, corpus, stem, prediction) of the texts below ``<model>/<corpus>/``."""
    read = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    at = F.input_file_name()
    return read.select(_below(at, 2).alias("model"), _below(at, 1).alias("corpus"), stem_of(at).alias("stem"), F.col("value").alias("prediction"))


def last_by_stem(rows: DataFrame, order: str, stem: str = "stem") -> DataFrame:
    """Rows keyed by stem; of several, the last."""
    columns = [c for c in rows.columns if c != stem]
    return rows.groupBy(stem).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(stem, "_row.*")


def texts(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """(stem, text) of every text file below a folder."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    return read.select(stem_of(F.input_file_name()).alias("stem"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, stem, sha256) of files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return read.select("path", stem_of("path").alias("stem"), F.sha2("content", 256).alias("sha256"))


def run_faults(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a run record that are missing or empty."""
    run = json_lines(spark, path, RUN)
    names = [f.name for f in T.StructType.fromDDL(RUN).fields]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names)))
    return run.select(each.alias("x")).where(F.coalesce(F.col("x.value"), F.lit("")) == "").select("x.key")


def distinct_folders(paths: list[str]) -> list[str]:
    """Folders, each once: local ones by what they resolve to, so links to one of them don't read it twice."""
    seen, out = set(), []
    for p in paths:
        local = p[5:] if p.startswith("file:") else p if "://" not in p else None
        at = os.path.realpath("/" + local.lstrip("/")) if local is not None else p.rstrip("/")
        if at not in seen:
            seen.add(at)
            out.append(p)
    return out


def rows_with_columns(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Scored rows of several files, in each of which some record must state each of ``required``.

    The first record mostly tells; a whole file is looked through only where it doesn't.
    """
    for p in paths:
        keys = spark.read.text(p).select(F.json_object_keys("value").alias("keys"))
        first = keys.first()
        lacking = sorted(set(required) - set((first and first["keys"]) or ()))
        if lacking:
            lacking = sorted(set(lacking) - {r.key for r in keys.select(F.explode("keys").alias("key")).where(F.col("key").isin(lacking)).distinct().collect()})
        if lacking:
            raise ValueError(f"{p} lacks columns {lacking}")
    return json_lines(spark, paths, SCORED)


def write_json(df: DataFrame, path: str, keep_nulls: bool = True, one_file: bool = False) -> None:
    """JSON lines. An existing vintage is never overwritten."""
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").option("ignoreNullFields", not keep_nulls).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
