"""Mixing sources to target weights by Poisson replication.

A source whose weight asks for r times its own rows gets repetition rate r. Each document's count is the
inverse of the Poisson distribution with mean r at a number in [0, 1) that a hash of seed and doc_id gives, so
the count needs no state and any executor finds the same one. A document is exploded by its count, and rows are
then dealt and sorted by a second hash.

Rows with a null source form a source of their own. A source without a weight keeps rate ``default`` (1); a
weight of 0 drops its rows; nulls in other columns and empty texts pass through; rows that repeat a doc_id get
the same count each; a row without an id draws its count from a hash of its columns (of all but maps). Where a column
has the name of an added one (mix_copy, mix_order), the added one's name gets an underscore. An empty table gives an
empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.llm.common import free_name

SEED = 17
#: A mean above this is split: counts of independent parts add up to the count of the whole.
LARGEST_MEAN = 16.0
UNIT = 1 << 52


def unit_hash(tag: str, *columns: str | Column) -> Column:
    """52 bits of an MD5 sum: the same number in any engine."""
    parts = [F.lit(tag), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def poisson_steps(mean: float) -> list[int]:
    """P(count <= k) for k = 0, 1, ... in units of 2**-52, up to where it reaches 1 in that grid."""
    term = total = math.exp(-mean)
    steps, k = [], 0
    while True:
        steps.append(min(UNIT, math.floor(total * UNIT)))
        k += 1
        term *= mean / k
        if k > mean and term * UNIT < 1:
            return steps
        total += term


def row_key(docs: DataFrame, key: str) -> Column:
    """The key as a string; a hash of the whole row where it is null."""
    hashed = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashed).cast("string")))


def poisson_count(mean: float, seed: int, key: Column) -> Column:
    """The inverse of the Poisson distribution at the number that seed and key hash to."""
    pieces = max(1, math.ceil(mean / LARGEST_MEAN))
    steps = F.array(*(F.lit(x) for x in poisson_steps(mean / pieces)))

    def drawn(i: int) -> Column:
        at = unit_hash(f"{seed}/{i}", key)
        return F.size(F.filter(steps, lambda step: step <= at))

    return sum((drawn(i) for i in range(1, pieces)), drawn(0))


def rates(docs: DataFrame, weights: dict[str, float], by: str = "source") -> dict[str | None, float]:
    """Repetition rate of each named source: its target rows over its own rows.

    Weights are shares of the rows of the named sources. Only one number a named source reaches the driver.
    """
    if any(not w >= 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    named = list(weights)
    counts = {r[0]: r[1] for r in docs.where(F.col(by).isin(named)).groupBy(F.col(by)).agg(F.count(F.lit(1))).collect()} if named else {}
    total, whole = sum(counts.values()), sum(weights[s] for s in counts) or 1.0
    return {s: weights[s] / whole * total / n for s, n in counts.items()}


def poisson_mix(docs: DataFrame, weights: dict[str, float], by: str = "source", key: str = "doc_id", seed: int = SEED, default: float = 1.0, shuffled: bool = True) -> DataFrame:
    """``docs`` with each row as often as its count says, plus mix_copy (from 0), in the order of mix_order."""
    at, n, copy, order = row_key(docs, key), free_name(docs, "mix_count"), free_name(docs, "mix_copy"), free_name(docs, "mix_order")
    count = poisson_count(default, seed, at) if default != 1.0 else F.lit(1)
    for source, rate in sorted(rates(docs, weights, by).items()):
        count = F.when(F.col(by) == source, poisson_count(rate, seed, at)).otherwise(count)
    mixed = docs.withColumn(n, count.cast("int")).where(F.col(n) > 0)
    mixed = mixed.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    mixed = mixed.withColumn(order, unit_hash(f"{seed}/order", at, copy))
    return mixed.orderBy(order, key, copy) if shuffled else mixed
