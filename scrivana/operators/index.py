"""Manifests, indexes over several corpora, fingerprints, comparisons and upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivana.staging import Scratch


def case_of(stem: Column, doc_type: Column) -> Column:
    """A stem without its ``_<doc_type>``; fails where the stem doesn't end with it."""
    suffix = F.concat(F.lit("_"), doc_type)
    return F.when(F.endswith(stem, suffix), F.substring(stem, F.lit(1), F.length(stem) - F.length(suffix))).otherwise(F.raise_error(F.concat(F.lit("stem without its document type: "), stem)))


def matrix(manifest: DataFrame, by: list[str], doc_type: str = "doc_type") -> DataFrame:
    """One row for each corpus: its pages, and its document types in order."""
    return manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_set(doc_type)).alias("doc_types"))


def require_clean(index: DataFrame, corpus: str = "corpus", clean: str = "clean") -> None:
    if index.where(F.col(corpus) == clean).isEmpty():
        raise ValueError(f"the index names no {clean!r} corpus")


def index_faults(index: DataFrame, paths: list[str], files: DataFrame, clean: str = "clean") -> DataFrame:
    """(corpus, fault): an index without its clean corpus, and files that it names (columns ``paths``) and that aren't there."""
    named = index.select("corpus", F.explode(F.array(*(F.col(p) for p in paths))).alias("path")).where(F.col("path").isNotNull())
    absent = named.join(files.select("path").distinct(), "path", "left_anti").select("corpus", F.concat(F.lit("no file "), "path").alias("fault"))
    without = index.agg(F.count_if(F.col("corpus") == clean).alias("n")).where("n = 0").select(F.lit(clean).alias("corpus"), F.lit("not in the index").alias("fault"))
    return absent.unionByName(without)


def fingerprint(rows: DataFrame, by: list[str], stem: str, digest: str) -> DataFrame:
    """SHA-256 over ``stem NUL digest LF`` of all rows in stem order, for each group; a row with a null adds nothing.

    The hash takes rows one after another, so a group is one sorted stream through one task: batches pass through, and
    nothing of a group is held but the state of its hash.
    """
    own = rows.select(*by, F.col(stem).alias("_s"), F.col(digest).alias("_d"))
    dealt = own.repartition(*by) if by else own.repartition(1)
    said = F.concat(F.col("_s").cast("string"), F.lit("\0"), F.col("_d"), F.lit("\n"))
    stream = dealt.sortWithinPartitions(*by, "_s", "_d").select(*by, F.coalesce(said, F.lit("")).cast("binary").alias("_said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, n, kinds = None, None, 0, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], kind) for k, kind in zip(group, kinds)), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=[*by, "fingerprint", "rows"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(by))]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))))) if by else [()] * batch.num_rows
            for key, part in zip(keys, batch.column(len(by)).to_pylist()):
                if key != group:
                    if state is not None:
                        yield result()
                    group, state, n = key, hashlib.sha256(), 0
                state.update(part)
                n += 1
        if state is not None:
            yield result()

    schema = T.StructType([*(own.schema[k] for k in by), T.StructField("fingerprint", T.StringType()), T.StructField("rows", T.LongType())])
    return stream.mapInArrow(run, schema)


def vintage_diff(left: DataFrame, right: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """(key, status): only_left, only_right, same or different. A digest counts only where both sides state it."""
    a = left.select(key, F.struct(*digests).alias("_l"))
    b = right.select(key, F.struct(*digests).alias("_r"))
    differs = F.lit(False)
    for d in digests:
        differs = differs | F.coalesce(F.col("_l")[d] != F.col("_r")[d], F.lit(False))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(differs, "different").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def examples(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The count and the first ``n`` values of each group, in order."""
    from scrivana.operators.windows import first_per_group

    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    first = first_per_group(rows, by, [value], n).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    return counts.join(first, by)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one side lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def unmatched_members(rows: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """Members that not every group has, with the number of groups that have them and of all groups."""
    pairs = rows.select(*group, *member).distinct()
    n = pairs.select(*group).distinct().agg(F.count(F.lit(1)).alias("groups"))
    held = pairs.groupBy(*member).agg(F.count(F.lit(1)).alias("held_by"))
    return held.join(F.broadcast(n)).where("held_by < groups")


def keyed_upsert(existing: DataFrame, fresh: DataFrame, key: list[str], order: str, still_there: DataFrame | None = None) -> DataFrame:
    """Existing rows with fresh ones in their places, the rest of the fresh after them, each side in its own order.

    With ``still_there`` (keys), an existing row that fresh doesn't replace stays only if its key is in it.
    """
    columns = [c for c in existing.columns if c not in (*key, order)]
    a = existing.select(*key, F.struct(order, *columns).alias("_old"))
    b = fresh.select(*key, F.struct(order, *columns).alias("_new"))
    both = a.join(b, key, "full_outer")
    if still_there is not None:
        both = both.join(still_there.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left").where(F.col("_new").isNotNull() | F.col("_there"))
    appended = F.col("_old").isNull()
    place = F.struct(appended.alias("a"), F.coalesce(F.col(f"_old.{order}"), F.col(f"_new.{order}")).alias("o"))
    return both.select(*key, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns), place.alias("place"))


def numbered(rows: DataFrame, place: str, to: str = "position") -> DataFrame:
    """Rows with their numbers 0, 1, ... in the order of ``place``, which goes, without gathering the table.

    The rows are dealt by ranges of places and staged with their partition and their number in it; a partition's rows
    then start after all rows of the partitions before. Only one row a partition is summed in one task.
    """
    ranged = rows.repartitionByRange(F.col(place)).sortWithinPartitions(place)
    placed = Scratch(rows.sparkSession, "numbered").put("rows", ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    parts = parts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return placed.join(parts, "_part").withColumn(to, F.col("_start") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_n", "_first", "_start", place)


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame, prefix: str, to: str) -> DataFrame:
    """Each row with the ``to`` of the longest prefix of its value, or null.

    Every length that some prefix has is looked up by equality, so no prefix is compared with every row.
    """
    lengths = F.broadcast(prefixes.agg(F.collect_set(F.length(prefix)).alias("_lengths")))
    keyed = rows.select(value).distinct().join(lengths).withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length(value))
    cut = keyed.withColumn("_prefix", F.substring(F.col(value), F.lit(1), F.col("_n")))
    hits = cut.join(prefixes.select(F.col(prefix).alias("_prefix"), F.col(to)), "_prefix")
    best = hits.groupBy(value).agg(F.max_by(to, "_n").alias(to))
    return rows.join(best, value, "left")


def reachable_names(first: DataFrame, second: DataFrame, blocked: DataFrame) -> DataFrame:
    """Blocked names that a word of ``first`` and one of ``second`` can form, in the block list's spelling.

    A blocked name is split at each of its spaces, so words are joined by equality instead of being combined.
    """
    names = blocked.select(F.col("name")).distinct().withColumn("_words", F.split(F.lower("name"), " "))
    cuts = names.where(F.size("_words") > 1).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)))
    halves = cuts.select("name", F.array_join(F.slice("_words", F.lit(1), F.col("_at")), " ").alias("_a"), F.array_join(F.slice("_words", F.col("_at") + 1, F.size("_words")), " ").alias("_b"))
    found = halves.join(first.select(F.lower("word").alias("_a")).distinct(), "_a").join(second.select(F.lower("word").alias("_b")).distinct(), "_b")
    return found.select("name").distinct()
