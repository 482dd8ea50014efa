"""Corpora as folders of files: a data source that prunes folders, and a writer that commits a whole vintage.

``register(spark)`` makes two formats known:

* ``corpus_folders`` reads the texts below folders, one row a file. Partitions are planned from listings alone: links are
  resolved, so a folder that is linked twice is read once, and filters on corpus, model, family and severity drop folders
  before any of their files is opened.
* ``vintage`` writes files below a new folder. Tasks write into a folder beside it, each file first under a name of the
  attempt's own; the commit puts a marker there and renames the folder, so a vintage is there whole or not at all. A
  failed write leaves nothing, a repeated task overwrites what its first attempt left, and a vintage is never overwritten.

Both reach files through Arrow's file systems, so paths may be local or in a store that Arrow knows.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

TEXTS = "model string, corpus string, family string, severity string, stem string, text string"
LABELS = ("model", "corpus", "family", "severity")
#: Bytes of files that one task reads, and files of a listing that it takes at most.
TASK_BYTES, TASK_FILES = 64 << 20, 20_000
BATCH_BYTES = 4 << 20
MARKER = "_VINTAGE.json"
UNFINISHED = ".unfinished-"


def reached(uri: str):
    """The Arrow file system of a path, and the path there; file:/a and file:///a are one."""
    from pyarrow import fs

    at = "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
    files, base = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
    return files, base.rstrip("/")


@dataclass
class Files(InputPartition):
    labels: tuple[str | None, ...]
    paths: tuple[str, ...]


class FolderReader(DataSourceReader):
    """Options: path; kind (``corpora``: ``<corpus>/transcripts/<stem>.md``, labels from the index ``matrix.jsonl`` beside
    them, ``predictions``: ``<model>/<corpus>/<stem>.md``, or ``texts``: all files below, without labels); suffix;
    committed (``true``: only folders with a marker)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.suffix = options["path"], options.get("kind", "corpora"), options.get("suffix", ".md")
        self.committed = options.get("committed", "false").lower() == "true"
        if self.kind not in ("corpora", "predictions", "texts"):
            raise ValueError(f"kind {self.kind!r}; expected corpora or predictions, or texts")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", ()) and len(f.attribute) == 1 else None
            if column in LABELS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((column, "in", (f.value,)))
            elif column in LABELS and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in LABELS and isinstance(f, StringStartsWith):
                self.wanted.append((column, "start", f.value))
            else:
                yield f

    def holds(self, labels: dict[str, str | None]) -> bool:
        def one(column: str, how: str, value) -> bool:
            own = labels[column]
            return own in value if how == "in" else own is not None and own.startswith(value)

        return all(one(*w) for w in self.wanted)

    def index(self, files, base: str) -> dict[str, tuple[str | None, str | None]]:
        from pyarrow.fs import FileType

        if files.get_file_info(f"{base}/matrix.jsonl").type != FileType.File:
            return {}
        with files.open_input_stream(f"{base}/matrix.jsonl") as read:
            rows = [json.loads(line) for line in read.read().decode().splitlines() if line.strip()]
        return {r["corpus"]: (r.get("family"), r.get("severity")) for r in rows}

    def folders(self) -> Iterator[tuple[dict[str, str | None], str]]:
        """Labels and folder of texts, from listings; folders that resolve to one are one, under the first name."""
        from pyarrow import fs

        files, base = reached(self.path)

        def below(folder: str) -> list[str]:
            found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            return sorted(x.path for x in found if x.type == fs.FileType.Directory and not re.match(r"[._]", x.base_name) and UNFINISHED not in x.base_name)

        if self.kind == "texts":
            labels = dict.fromkeys(LABELS)
            if self.holds(labels) and (not self.committed or files.get_file_info(f"{base}/{MARKER}").type == fs.FileType.File):
                yield labels, base
            return
        index = self.index(files, base) if self.kind == "corpora" else {}
        models = [(None, base)] if self.kind == "corpora" else [(m.rsplit("/", 1)[-1], m) for m in below(base)]
        seen = set()
        for model, folder in models:
            for corpus in below(folder):
                name = corpus.rsplit("/", 1)[-1]
                family, severity = index.get(name, (None, None))
                resolved = os.path.realpath(corpus) if isinstance(files, fs.LocalFileSystem) else corpus
                if (model, resolved) in seen:
                    continue
                seen.add((model, resolved))
                labels = {"model": model, "corpus": name, "family": family, "severity": severity}
                if self.holds(labels) and (not self.committed or files.get_file_info(f"{corpus}/{MARKER}").type == fs.FileType.File):
                    yield labels, f"{corpus}/transcripts" if self.kind == "corpora" else corpus

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, _ = reached(self.path)
        out = []
        for labels, folder in self.folders():
            held, size = [], 0
            listed = fs.FileSelector(folder, allow_not_found=self.kind != "texts", recursive=self.kind == "texts")
            for x in sorted(files.get_file_info(listed), key=lambda x: x.path):
                if x.type != fs.FileType.File or not x.base_name.endswith(self.suffix):
                    continue
                if held and (size + (x.size or 0) > TASK_BYTES or len(held) >= TASK_FILES):
                    out.append(Files(tuple(labels[c] for c in LABELS), tuple(held)))
                    held, size = [], 0
                held.append(x.path)
                size += x.size or 0
            if held:
                out.append(Files(tuple(labels[c] for c in LABELS), tuple(held)))
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = reached(self.path)
        stems: list[str] = []
        texts: list[str] = []
        size = 0

        def batch() -> pa.RecordBatch:
            labels = [pa.array([x] * len(stems), pa.string()) for x in partition.labels]
            return pa.RecordBatch.from_arrays([*labels, pa.array(stems, pa.string()), pa.array(texts, pa.string())], names=[*LABELS, "stem", "text"])

        for path in partition.paths if partition else ():
            with files.open_input_stream(path) as read:
                raw = read.read()
            stems.append(path.rsplit("/", 1)[-1].removesuffix(self.suffix))
            texts.append(raw.decode())
            size += len(raw)
            if size > BATCH_BYTES:
                yield batch()
                stems, texts, size = [], [], 0
        if stems:
            yield batch()


class CorpusFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_folders"

    def schema(self) -> str:
        return TEXTS

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class VintageWriter(DataSourceArrowWriter):
    """Rows are (path, content, line): a file each, or (``line``) a line of ``<path>/part-<partition>.jsonl``."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileType

        self.folder = folder.rstrip("/")
        files, base = reached(self.folder)
        if files.get_file_info(base).type != FileType.NotFound:
            raise ValueError(f"{folder} is there already; a vintage is never overwritten")
        self.beside = f"{base}{UNFINISHED}{uuid.uuid4().hex}"
        files.create_dir(f"{self.beside}/_attempts")

    def make(self, files, folder: str, made: set[str]) -> None:
        """A folder below ``beside``, which must be there: a task that outlives an aborted write doesn't bring it back."""
        if folder not in made and folder != self.beside:
            self.make(files, folder.rsplit("/", 1)[0], made)
            files.create_dir(folder, recursive=False)
            made.add(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, _ = reached(self.folder)
        own = f"{self.beside}/_attempts/{context.taskAttemptId()}"
        lines: dict[str, object] = {}
        n = size = 0
        made: set[str] = set()
        self.make(files, own, made)
        for batch in iterator:
            for path, content, line in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "line"))):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the vintage")
                raw = (content or "").encode()
                size += len(raw)
                if line:
                    if path not in lines:
                        lines[path] = files.open_output_stream(f"{own}/{len(lines)}.jsonl")
                    lines[path].write(raw + b"\n")
                    continue
                self.make(files, f"{self.beside}/{path}".rsplit("/", 1)[0], made)
                with files.open_output_stream(f"{own}/file") as out:
                    out.write(raw)
                files.move(f"{own}/file", f"{self.beside}/{path}")
                n += 1
        for k, (path, out) in enumerate(lines.items()):
            out.close()
            self.make(files, f"{self.beside}/{path}", made)
            files.move(f"{own}/{k}.jsonl", f"{self.beside}/{path}/part-{context.partitionId():05d}.jsonl")
            n += 1
        files.delete_dir(own)
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        files, base = reached(self.folder)
        there = [m for m in messages if m is not None]
        files.delete_dir(f"{self.beside}/_attempts")  # with what attempts that died have left
        with files.open_output_stream(f"{self.beside}/{MARKER}") as out:
            out.write(json.dumps({"files": sum(m.files for m in there), "bytes": sum(m.bytes for m in there)}).encode())
        if files.get_file_info(base).type != FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.folder} appeared meanwhile; a vintage is never overwritten")
        files.move(self.beside, base)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what was written. Tasks may still run: they fail once the folder is gone."""
        from pyarrow.fs import FileType

        files, _ = reached(self.folder)
        for _ in range(50):
            try:
                if files.get_file_info(self.beside).type == FileType.NotFound:
                    return
                files.delete_dir(self.beside)
            except OSError:  # a task has just written there
                time.sleep(0.1)


class Vintage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vintage"

    def schema(self) -> str:
        return "path string, content string, line boolean"

    def writer(self, schema, overwrite: bool) -> VintageWriter:
        return VintageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets it push filters to them."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning runs in a process that has no shipped files
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFolders)
    spark.dataSource.register(Vintage)


def folder_texts(spark: SparkSession, path: str, kind: str = "corpora", **options: str) -> DataFrame:
    """model, corpus, family, severity, stem and text of the files below a folder; filters on the labels prune folders."""
    register(spark)
    return spark.read.format("corpus_folders").options(kind=kind, **options).load(path)


def texts_below(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """(stem, text) of every file below a folder, empty ones too. A task opens thousands of files, in less time than Spark's
    own reader, which makes a task of some thirty and leaves out empty ones."""
    return folder_texts(spark, folder, "texts", suffix=suffix).select("stem", "text")


def files_of(rows: DataFrame, path, content) -> DataFrame:
    """A file a row."""
    return rows.select(path.alias("path"), content.cast("string").alias("content"), F.lit(False).alias("line"))


def lines_of(rows: DataFrame, path: str, keep_nulls: bool = True) -> DataFrame:
    """A JSON line a row, in files below ``path``."""
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": str(not keep_nulls).lower()})
    return rows.select(F.lit(path).alias("path"), record.alias("content"), F.lit(True).alias("line"))


def write_vintage(parts: DataFrame, folder: str) -> None:
    """Commits rows of (path, content, line) as a new folder. A path that two rows name fails."""
    register(parts.sparkSession)
    named = parts.where(~F.col("line")).groupBy("path").count().where("count > 1")
    twice = [r.path for r in named.limit(5).collect()]
    if twice:
        raise ValueError(f"files named twice: {twice}")
    parts.select("path", "content", "line").write.format("vintage").mode("append").save(folder)
