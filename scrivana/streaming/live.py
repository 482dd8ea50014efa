"""Streams: an extension, as the batch corpora have none.

Scored rows arrive as files; windows of event time give running reports, and records are upserted batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivana.operators.index import keyed_upsert


def scored_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def windowed_report(rows: DataFrame, time: str, by: list[str], value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, missing and mean of each window; rows later than the watermark are dropped."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "pages", "missing", "mean")


def upsert_stream(fresh: DataFrame, key: list[str], order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces rows of the same key below ``target``/<batch>; the highest batch is the table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{target}/{number}"
        if number == 0:
            batch.write.mode("overwrite").parquet(path)
            return
        merged = keyed_upsert(spark.read.parquet(f"{target}/{number - 1}"), batch, key, order)
        merged.withColumn(order, F.col("place.o")).drop("place").write.mode("overwrite").parquet(path)

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
