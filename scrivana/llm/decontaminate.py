"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Test items are short and documents long, so signatures of whole documents would see nothing. Containment is asked
from the item's side. Items are partitioned by the size of their shingle set; an item's sketch is its k least shingles
under one hash function, and k belongs to the partition: the least number with which an item of that size, of whose
shingles a document holds the share asked for, is missed with a probability below 1e-6 (for sets of up to 16 it is
never missed, as the sketch outnumbers the shingles that may be absent). A document that holds a shingle of the sketch,
and has enough shingles for the item at all, is a candidate; each candidate pair is then verified by counting the
distinct shingles they share, word by word.

Shingles are five words (A-Z lower-cased; an item with fewer words is one shorter shingle, met by the document's
shingles of that many words); a document is contaminated by an item if it contains at least 0.75 of them.

Every row is judged by its own text, so rows that repeat an id with other texts, rows without an id and items without
an id are searched and found like all others; equal rows are judged alike and give one pair. Null and empty texts
contain nothing and are never contaminated; items without words match nothing; ties don't arise; an empty benchmark
leaves every document clean; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch, free_name

WIDTH = 5
THRESHOLD = (75, 100)
MISS = 1e-6
SEED = 29
#: Rows of (shingle, item) or of keys that may be broadcast, 16 to 24 bytes each; larger tables are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_SPACES = r"[\x20\x09-\x0D]+"


def least_shared(n: int) -> int:
    """How many of an item's n shingles a document must hold."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


def sketch_size(n: int) -> int:
    """The least k with which the k least of n shingles miss a document that holds just enough of them below MISS."""
    absent = n - least_shared(n)
    return next(k for k in range(1, n + 1) if math.comb(absent, k) < MISS * math.comb(n, k))


def size_class(n: int) -> int:
    """Partition c holds the sizes above 2**(c - 1), up to 2**c."""
    return (n - 1).bit_length()


#: Sketch size by partition: its largest need. From 2**12 shingles on the number no longer grows.
SKETCHES = [max(sketch_size(n) for n in range((1 << c >> 1) + 1, (1 << c) + 1)) for c in range(13)]


def words(text: Column) -> Column:
    """Words with A-Z in lower case; of a text without words, one empty one."""
    said = F.coalesce(text, F.lit(""))
    plain = F.octet_length(said) == F.char_length(said)
    low = F.when(plain, F.lower(said)).otherwise(F.translate(said, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.split(F.btrim(low, F.lit(" \t\n\x0b\x0c\r")), _SPACES)


def shingle(of_words: Column, before: Column, width: int) -> Column:
    """The 64-bit hash of the ``width`` words after the first ``before``."""
    return F.xxhash64(*(F.element_at(of_words, before + k) for k in range(1, width + 1)))


def gram(of_words: Column, before: Column, width: int) -> Column:
    """The same words as text."""
    return F.concat_ws(" ", *(F.element_at(of_words, before + k) for k in range(1, width + 1)))


def item_sets(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(code, item, width, n, need, runs, sketch) of each item that has words; ``code`` stands for its id and text, and
    runs are its distinct shingles with their words."""
    code = F.xxhash64(F.lit(SEED), F.col(key).isNull(), F.col(key), F.col(text))
    w = items.select(code.alias("code"), F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.col("w")[0] != "").withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))

    def of_width(k: int) -> Column:
        run = lambda i: F.struct(shingle(F.col("w"), i, k).alias("shingle"), gram(F.col("w"), i, k).alias("gram"))
        return F.transform(F.sequence(F.lit(0), F.size("w") - k), run)

    runs = F.lit(None)
    for k in range(WIDTH, 0, -1):
        runs = F.when(F.col("width") == k, of_width(k)).otherwise(runs)
    w = w.withColumn("runs", F.array_distinct(runs)).withColumn("n", F.size("runs"))
    partition = F.least(F.ceil(F.log2(F.col("n").cast("double"))).cast("int"), F.lit(len(SKETCHES) - 1))
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct(F.xxhash64(F.lit(SEED), r["shingle"]).alias("rank"), r["shingle"].alias("shingle"))))
    sketch = F.slice(ranked["shingle"], 1, F.element_at(F.array(*map(F.lit, SKETCHES)), partition + 1))
    need = F.ceil(F.col("n") * THRESHOLD[0] / THRESHOLD[1]).cast("int")
    return w.select("code", "item", "width", "n", need.alias("need"), "runs", sketch.alias("sketch")).dropDuplicates(["code"])


def _sized(df: DataFrame) -> DataFrame:
    """A broadcast of a written table of small rows, where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated_pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, its_text, item, n_shared, n_shingles) of every document and item it contains; ``its_text`` is a hash."""
    sets = scratch.put("items", item_sets(items, item_key, item_text))
    probe = scratch.put("probes", sets.select("code", "width", "need", F.explode("sketch").alias("shingle")))
    widths = sorted((r[0] for r in sets.select("width").distinct().collect()), reverse=True) or [WIDTH]
    own = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("its_text"), F.col(text).alias("t"))

    def rows(of: DataFrame, with_words: bool) -> DataFrame:
        """(doc, its_text, n_words, width, shingle) of every place and width, or with the words there as ``gram``.

        A document's words stay one array and a row a place holds no more than numbers and its own words, so all of this
        is one generated loop, and memory doesn't grow with a document's places.
        """
        held = of.select("doc", "its_text", words(F.col("t")).alias("w"))
        places = F.when(F.size("w") >= widths[-1], F.sequence(F.lit(0), F.size("w") - widths[-1]))
        held = held.select("*", F.explode(places).alias("before")).withColumn("n_words", F.size("w"))

        def at(k: int) -> list[Column]:
            return [F.lit(k).alias("width"), shingle(F.col("w"), F.col("before"), k).alias("shingle"), *([gram(F.col("w"), F.col("before"), k).alias("gram")] if with_words else [])]

        if len(widths) == 1:
            return held.select("doc", "its_text", "n_words", *at(widths[0]))
        each = F.explode(F.array_compact(F.array(*(F.when(F.col("before") + k <= F.col("n_words"), F.struct(*at(k))) for k in widths))))
        return held.select("doc", "its_text", "n_words", each.alias("x")).select("doc", "its_text", "n_words", "x.*")

    enough = F.col("n_words") - F.col("width") + 1 >= F.col("need")
    candidates = scratch.put("candidates", rows(own, False).join(_sized(probe), ["width", "shingle"]).where(enough).select("doc", "its_text", "code").distinct())
    some = scratch.put("candidate_docs", candidates.select("doc", "its_text").distinct())
    same = F.col("doc").eqNullSafe(F.col("doc_")) & F.col("its_text").eqNullSafe(F.col("its_text_"))
    named = [F.col("doc").alias("doc_"), F.col("its_text").alias("its_text_")]
    read = own.join(_sized(some).select(*named), same, "left_semi")
    of_items = scratch.put("grams", sets.select("code", "width", F.explode("runs").alias("r")).select("code", "width", "r.*"))
    shared = rows(read, True).join(_sized(of_items), ["width", "shingle", "gram"]).select("doc", "its_text", "code", "gram").distinct()
    counted = shared.groupBy("doc", "its_text", "code").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    asked = candidates.select(*named, F.col("code").alias("code_"))
    found = counted.join(asked, same & (F.col("code") == F.col("code_")), "left_semi").join(sets.select("code", "item", "n", "need"), "code")
    return found.where("n_shared >= need").select("doc", "its_text", "item", "n_shared", F.col("n").alias("n_shingles"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """The clean rows of ``docs`` (columns as they are), and the contaminated pairs."""
    scratch = scratch or Scratch(spark, "decontaminate")
    pairs = scratch.put("pairs", contaminated_pairs(spark, docs, items, scratch, key, text, **options))
    doc, its_text = free_name(docs, "doc"), free_name(docs, "its_text")
    bad = scratch.put("contaminated", pairs.select(F.col("doc").alias(doc), F.col("its_text").alias(its_text)).distinct())
    clean = docs.join(_sized(bad), F.col(key).eqNullSafe(F.col(doc)) & F.xxhash64(F.col(text)).eqNullSafe(F.col(its_text)), "left_anti")
    return clean, pairs.drop("its_text").distinct()
