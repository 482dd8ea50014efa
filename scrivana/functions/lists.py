"""Sentinels, pipe-delimited lists and parallel groups of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_FOUND = "NOT_FOUND"


def is_present(value: Column) -> Column:
    """Not null, not empty, not the sentinel."""
    return ~F.coalesce(value, F.lit("")).isin("", NOT_FOUND)


def present(value: Column) -> Column:
    return F.when(is_present(value), value)


def or_not_found(value: Column) -> Column:
    return F.coalesce(value, F.lit(NOT_FOUND))


def flatten_fields(entries: DataFrame, columns: list[str], key: str = "case_id", fields: str = "fields") -> DataFrame:
    """One column for each name, the sentinel where a field is missing, ordered by key."""
    return entries.select(key, *(or_not_found(F.col(fields)[c]).alias(c) for c in columns)).orderBy(key)


def split_pipes(value: Column) -> Column:
    return F.transform(F.split(value, r"\|"), lambda x: F.trim(x))


def counts_agree(*lists: Column) -> Column:
    """Parallel lists have one length."""
    return F.size(F.array_distinct(F.array(*(F.size(x) for x in lists)))) == 1


def explode_group(entries: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows of a parallel group: line_no from 0, and one column for each list (list column -> item column).

    A group that is the sentinel alone has no rows; a ragged group fails.
    """
    rows = entries.where(~F.forall(F.array(*(F.col(c) for c in columns)), lambda x: x == NOT_FOUND))
    rows = rows.withColumns({c: split_pipes(F.col(c)) for c in columns})
    ragged = F.assert_true(counts_agree(*(F.col(c) for c in columns)), F.lit(f"ragged group: {', '.join(columns)}"))
    rows = rows.withColumn("_checked", ragged).withColumn("_zip", F.when(F.col("_checked").isNull(), F.arrays_zip(*columns)))
    rows = rows.select(*keep, F.posexplode("_zip").alias("line_no", "_item"))
    return rows.select(*keep, "line_no", *(F.col("_item")[c].alias(to) for c, to in columns.items()))


def interpolate(template: Column, fields: Column) -> Column:
    """``{NAME}`` replaced by the field's value, the sentinel by nothing; an unknown name fails."""
    filled = F.aggregate(F.map_entries(fields), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.when(is_present(e["value"]), e["value"]).otherwise("")))
    unknown = F.regexp_extract(filled, r"\{[A-Z_0-9]+\}", 0)
    return F.when(unknown == "", filled).otherwise(F.raise_error(F.concat(F.lit("unknown field "), unknown)))


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_0-9]+)\}"))


def braces_balanced(template: Column) -> Column:
    """No brace is left once whole placeholders are taken out."""
    return ~F.regexp_replace(template, r"\{[^{}]*\}", "").rlike(r"[{}]")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it, in n^1.5 steps: an array can't grow in place, so sums are taken in
    pieces of the root of n, and each piece is then raised by all pieces before it."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    scan = lambda a: F.slice(F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))), F.lit(1), F.size(a))
    raised = lambda pieces: F.flatten(F.zip_with(pieces, scan(F.transform(pieces, total)), lambda p, t: F.transform(scan(p), lambda y: y + t)))

    def whole(a: Column) -> Column:
        n = F.size(a)
        root = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        count = F.ceil(n / root).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(a, i * root + 1, root))
        return let(pieces, raised)

    return let(numbers, whole)
