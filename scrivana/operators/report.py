"""Grouped reports with exact nearest-rank percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.staging import Scratch, spread

KEYS = ("model", "corpus", "doc_type", "family", "severity")
METRICS = ("normalised_cer", "strict_cer", "normalised_wer", "table_cell_error_rate")
COUNTS = ("table_cells_misplaced", "table_rows_missing", "table_rows_spurious")
PERCENTILES = (50, 90, 100)


#: Buckets of values in each doubling; more than a doubling's thousandth of a group in one bucket are so many equal values.
FINENESS = 4096
#: Places of ranks, in rows of a written table, up to which they are broadcast.
FEW = 250_000
PLAIN = -1


def bucket(value: Column) -> Column:
    """A whole number that doesn't fall while values rise: sign and logarithm in steps. NaN comes last."""
    steps = F.floor(F.log2(F.least(F.abs(value), F.lit(1.7976931348623157e308))) * FINENESS) + 1075 * FINENESS
    return F.when(F.isnan(value), 1 << 40).when(value == 0, 0).otherwise((F.signum(value) * (F.greatest(steps, F.lit(0)) + 1)).cast("long"))


def histograms(rows: DataFrame, keys: list[str], values: list[str], measures: dict[str, Column]) -> DataFrame:
    """How often each value stands in each group of all keys, in one pass over the rows: keys, m (the value's number), v, n.

    Rows of m = PLAIN hold, besides, the sums of ``measures`` and the number of rows.
    """
    cells = F.array(F.struct(F.lit(PLAIN).alias("m"), F.lit(None).cast("double").alias("v")), *(F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)))
    long = rows.select(*keys, *(x.alias(f"_s_{name}") for name, x in measures.items()), F.explode(cells).alias("_x"))
    long = long.select("*", "_x.m", "_x.v").where((F.col("m") == PLAIN) | F.col("v").isNotNull())
    sums = (F.sum(F.when(F.col("m") == PLAIN, F.col(f"_s_{name}"))).alias(f"_s_{name}") for name in measures)
    return long.groupBy(*keys, "m", "v").agg(F.count(F.lit(1)).alias("n"), *sums)


def expanded(rows: DataFrame, keys: list[str], sets: list[int]) -> DataFrame:
    """A row for each grouping set (``_set``: as SQL's GROUPING, a bit for each key that is left out, the first key's the
    highest); keys that are left out are null."""
    return rows.withColumn("_set", F.explode(F.array(*map(F.lit, sets)))).withColumns(kept_keys(keys))


def kept_keys(keys: list[str]) -> dict[str, Column]:
    """The keys of a row's set."""
    return {k: F.when(F.col("_set").bitwiseAND(1 << (len(keys) - 1 - i)) == 0, F.col(k)) for i, k in enumerate(keys)}


def statistics(rows: DataFrame, keys: list[str], sets: list[int], values: list[str], percentiles: tuple[int, ...], measures: dict[str, Column]) -> DataFrame:
    """Per grouping set and combination: ``pages`` (rows), sums of ``measures``, and of each value its mean and the exact
    values at ranks max(1, ceil(p * n / 100)) of the non-null ones.

    The rows are read once, into histograms by all keys. Those are merged by bucket, and only the buckets, whose number the
    input's size doesn't raise, for every grouping set: their counts say in which bucket each rank lies. Only the values in
    such buckets are then merged for the sets that asked. So no group is gathered, what a task puts in order is the buckets
    of one group or the values of one bucket, and no row of the histograms is repeated for a set that doesn't need it.
    """
    scratch = Scratch(rows.sparkSession, "report")
    fine = scratch.put("fine", histograms(rows, keys, values, measures))
    group = ["_set", *keys]
    sums = [f"_s_{name}" for name in measures]
    base = fine.withColumn("b", bucket(F.col("v"))).groupBy(*keys, "m", "b")
    base = scratch.put("base", base.agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), *(F.sum(s).alias(s) for s in sums)))
    merged = expanded(spread(base), keys, sets).groupBy(*group, "m", "b")
    coarse = scratch.put("coarse", merged.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), *(F.sum(s).alias(s) for s in sums)))

    by_metric = Window.partitionBy(*group, "m")
    counted = coarse.where(F.col("m") != PLAIN).withColumns({"upto": F.sum("n").over(by_metric.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(by_metric)})
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.greatest(F.lit(1), F.floor((F.col("all") * p + 99) / 100)).alias("rank")) for i, p in enumerate(percentiles)))).alias("_r")
    places = counted.select(*group, "m", "b", (F.col("upto") - F.col("n")).alias("before"), "upto", ranks).select("*", "_r.p", "_r.rank").where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    names = {c: f"_t{i}" for i, c in enumerate([*group, "m", "b"])}
    places = scratch.put("places", places.select(*(F.col(c).alias(n) for c, n in names.items()), "p", (F.col("rank") - F.col("before")).alias("within")))
    def equal(names: dict[str, str]) -> Column:
        return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))

    # which sets ask for a bucket of all keys, and for which ranks in it
    own = {c: f"_o{i}" for i, c in enumerate([*keys, "m", "b"])}
    buckets = spread(base.where(F.col("m") != PLAIN).select(*keys, "m", "b", *(F.col(c).alias(n) for c, n in own.items())))
    asked = expanded(buckets, keys, sets).join(F.broadcast(places) if places.count() <= FEW else places, equal(names))
    asked = scratch.put("asked", asked.groupBy(*own.values()).agg(F.collect_list(F.struct("_set", "p", "within")).alias("_asked")))
    near = fine.where(F.col("m") != PLAIN).select(*keys, "m", "v", "n", bucket(F.col("v")).alias("b"))
    near = near.join(F.broadcast(asked) if asked.count() <= FEW else asked, equal(own)).select(*keys, "m", "v", "n", F.explode("_asked").alias("_a")).select("*", "_a.*")
    near = near.withColumns(kept_keys(keys)).groupBy(*group, "m", "p", "within", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group, "m", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("upto", upto).where(F.col("upto") >= F.col("within")).groupBy(*group, "m", "p").agg(F.min("v").alias("x"))

    means = coarse.where(F.col("m") != PLAIN).groupBy(*group, "m").agg((F.sum("total") / F.sum("n")).alias("x")).withColumn("p", F.lit(PLAIN))
    plain = coarse.where(F.col("m") == PLAIN).select(*group, "m", F.col("n").alias("pages"), *sums)
    cells = [plain, found, means]
    total = (1 << len(keys)) - 1
    if total in sets:  # a group even where there is no row
        cells.append(rows.sparkSession.range(1).select(F.lit(total).alias("_set"), *(F.lit(None).cast(fine.schema[k].dataType).alias(k) for k in keys), F.lit(0).cast("long").alias("pages"), *(F.lit(0).cast(fine.schema[s].dataType).alias(s) for s in sums)))
    rows_ = cells[0]
    for other in cells[1:]:
        rows_ = rows_.unionByName(other, allowMissingColumns=True)
    picked = [F.max(F.when((F.col("m") == j) & (F.col("p") == i), F.col("x"))).alias(f"{v}_{name}") for j, v in enumerate(values) for i, name in [*enumerate(f"p{p}" for p in percentiles), (PLAIN, "mean")]]
    return rows_.groupBy(*group).agg(F.max("pages").alias("pages"), *(F.max(f"_s_{name}").alias(name) for name in measures), *picked)


def nearest_ranks(rows: DataFrame, keys: list[str], values: list[str], percentiles: tuple[int, ...]) -> DataFrame:
    """For each group the value at rank max(1, ceil(p * n / 100)) of the non-null values of each column, exactly.

    Columns: ``<value>_p<percentile>``; groups may have null keys, and one without any value is left out.
    """
    out = statistics(rows, keys, [0], values, percentiles, {})
    there = F.coalesce(*(F.col(f"{v}_mean") for v in values)).isNotNull()
    return out.where(there).select(*keys, *(f"{v}_p{p}" for v in values for p in percentiles))


def report_cube(rows: DataFrame, keys: list[str], sets: list[list[str]] | None = None, metrics: tuple[str, ...] = METRICS, percentiles: tuple[int, ...] = PERCENTILES, counts: tuple[str, ...] = COUNTS, allowed: tuple[str, ...] = KEYS) -> DataFrame:
    """``report`` by every subset of the keys (or by those of ``sets``) from one pass over the rows.

    ``grouping`` tells them apart as SQL's GROUPING does; keys that a subset leaves out are null.
    """
    unknown = [k for k in keys if k not in allowed]
    if unknown:
        raise ValueError(f"unknown group keys {unknown}; expected some of {list(allowed)}")
    ids = range(1 << len(keys)) if sets is None else [sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets]
    present = F.coalesce(F.col("prediction_present"), F.lit(False))
    measures = {
        "missing": (~present).cast("long"),
        "degenerate": F.coalesce(F.col("degenerate"), F.lit(False)).cast("long"),
        **{c: F.when(present, F.col(c)) for c in counts},
        "unverified": (~F.coalesce(F.col("verified"), F.lit(False))).cast("long"),
    }
    seen = rows.withColumns({m: F.when(present, F.col(m)) for m in metrics})
    out = statistics(seen, keys, sorted(set(ids)), list(metrics), percentiles, measures)
    order = [f"{m}_{x}" for m in metrics for x in (*(f"p{p}" for p in percentiles), "mean")]
    verified = F.when(F.col("pages") > 0, F.col("unverified") == 0).alias("verified")
    whole = (F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts)
    return out.select(F.col("_set").alias("grouping"), *keys, "pages", "missing", "degenerate", *whole, verified, *order)


def report(rows: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS, percentiles: tuple[int, ...] = PERCENTILES, counts: tuple[str, ...] = COUNTS, allowed: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each combination of ``by``: pages, missing, degenerate, sums, percentiles and means.

    Percentiles and means are over present pages with a value. Groups are ordered by their keys as strings.
    """
    return report_cube(rows, by, [by], metrics, percentiles, counts, allowed).drop("grouping").orderBy(*(F.col(k).cast("string") for k in by))


def as_markdown(table: DataFrame) -> str:
    """A pipe table: floats with four decimals, nulls as a dash, pipes inside values escaped."""

    def cell(x) -> str:
        return "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in table.collect()]) + "\n"


def merge_shards(timings: DataFrame, by: list[str]) -> DataFrame:
    """Shards of one run: images add up, seconds are the slowest shard's, the rate is a floor if any includes loading."""
    merged = timings.groupBy(*by).agg(F.sum("images").alias("images"), F.max("seconds").alias("seconds"), F.bool_or("includes_load").alias("is_floor"))
    return merged.withColumn("images_per_minute", 60 * F.col("images") / F.col("seconds"))
