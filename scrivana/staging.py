"""Staged tables: Parquet in the folder of ``spark.checkpoint.dir``, which every executor reaches.

They cut lineage, so a lost executor costs only its own tasks, and what was drawn or numbered when they were written
stays as it is however often they are read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from scrivana import ship

CHECKPOINT = "spark.checkpoint.dir"
#: With it, Spark removes the shuffle files of a query when the query is over.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a task that does much for each row: no fewer than the first, no more than the second, or the third where rows of
#: one key are then put together.
LEAST_ROWS, MOST_ROWS, MOST_KEYED = 256, 20_000, 400_000


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores, for steps whose time bears no relation to a table's bytes, those of one key to one place.
    Spark makes tasks by bytes: a million short rows come in a file or two, and one task would take them all."""
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    return rows.repartition(max(min(n // LEAST_ROWS, 4 * cores), n // (MOST_KEYED if by else MOST_ROWS), 1), *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Without one, only a local master may fall back to a temporary folder."""
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scrivana-")
        spark.conf.set(CHECKPOINT, base)
    return base.rstrip("/")


class Scratch:
    """Named tables of one run of an operator, each written once and read from then on, so that nothing needs the shuffle
    files of the query that wrote it."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANED, None)
        self.spark.conf.set(CLEANED, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANED) if before is None else self.spark.conf.set(CLEANED, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
