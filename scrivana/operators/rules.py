"""Validation rules. Each is a column: an array of what it finds in an entry (field, position, rule, message).

``check`` puts any number of them into one pass over the entries: arrays side by side, exploded once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.fit import Advances, Budget, fit_text
from scrivana.functions.lists import NOT_FOUND, split_pipes
from scrivana.functions.values import abn_is_valid, gst_inclusive

# Formats of dates, amounts and booleans.
FORMATS = {"date": r"^\d{2}/\d{2}/\d{4}\z", "range": r"^\d{2}/\d{2}/\d{4} - \d{2}/\d{2}/\d{4}\z", "amount": r"^-?\d+\.\d{2}\z", "boolean": r"^(?i:true|false)\z"}


FINDINGS = "array<struct<field:string,position:int,rule:string,message:string>>"


def finding(rule: str, message: Column, field: Column | None = None, position: Column | None = None) -> Column:
    parts = {"field": field, "position": position, "rule": F.lit(rule), "message": message}
    return F.struct(*((F.lit(None) if x is None else x).alias(name) for name, x in parts.items()))


def _where(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found).cast(FINDINGS)).otherwise(F.array().cast(FINDINGS))


def _among(items: Column, found: Callable[[Column, Column], Column]) -> Column:
    """What is found at the elements of an array; ``found`` gives null where there is nothing."""
    return F.coalesce(F.array_compact(F.transform(items, found)).cast(FINDINGS), F.array().cast(FINDINGS))


def check(entries: DataFrame, *rules: Column) -> DataFrame:
    """case_id, field, position, rule and message of everything that the rules find."""
    return entries.select("case_id", F.explode(F.concat(*rules)).alias("_f")).select("case_id", "_f.*")


def required_fields(required: dict[str, list[str]]) -> Column:
    """Fields that an entry's document type requires and it lacks; unknown types too."""
    known = F.create_map(*(x for t, names in required.items() for x in (F.lit(t), F.array(*map(F.lit, names)))))
    unknown = _where(~F.col("doc_type").isin(*required), finding("doc_type", F.concat(F.lit("unknown type "), F.col("doc_type"))))
    lacking = _among(F.try_element_at(known, F.col("doc_type")), lambda name, _: F.when(~F.map_contains_key("fields", name), finding("required", F.lit("missing"), name)))
    return F.concat(unknown, lacking)


#: Layouts up to which they go to the entries, not the entries to them.
FEW_LAYOUTS = 10_000


def with_layouts(entries: DataFrame, layouts: DataFrame) -> DataFrame:
    """Entries that know whether their layout is one of ``layouts``, which are counted before they are broadcast."""
    known = layouts.select("layout", F.lit(True).alias("_layout_is_known")).distinct()
    return entries.join(F.broadcast(known) if known.count() <= FEW_LAYOUTS else known, "layout", "left")


def unknown_layouts() -> Column:
    """Layouts that there aren't; the entries come from ``with_layouts``."""
    return _where(F.col("_layout_is_known").isNull(), finding("layout", F.concat(F.lit("no layout "), F.col("layout"))))


def _of_form(value: Column, kind: str) -> Column:
    return (value == NOT_FOUND) | value.rlike(FORMATS[kind])


def _not_valid(kind: str, value: Column, field: Column, position: Column | None = None) -> Column:
    return finding(f"format_{kind}", F.concat(F.lit("not a valid value: "), value), field, position)


def formats(kinds: dict[str, list[str]]) -> Column:
    """Scalar fields (kind -> names) that aren't of their form; the sentinel is legal."""
    return F.concat(*(_where(~_of_form(F.col("fields")[n], kind), _not_valid(kind, F.col("fields")[n], F.lit(n))) for kind, names in kinds.items() for n in names))


def list_formats(kinds: dict[str, list[str]]) -> Column:
    """The same for every element of pipe lists, with its position."""

    def of(kind: str, name: str) -> Column:
        return _among(split_pipes(F.col("fields")[name]), lambda x, i: F.when(~_of_form(x, kind), _not_valid(kind, x, F.lit(name), i)))

    return F.concat(*(of(kind, name) for kind, names in kinds.items() for name in names))


def business_numbers(field: str = "BUSINESS_ABN") -> Column:
    value = F.col("fields")[field]
    return _where((value != NOT_FOUND) & ~abn_is_valid(value), finding("abn", F.concat(F.lit("checksum fails: "), value), F.lit(field)))


def parallel_counts(groups: dict[str, list[str]]) -> Column:
    """Groups of lists with unequal counts."""
    parts = []
    for group, names in groups.items():
        counts = F.array(*(F.size(F.split(F.col("fields")[n], r"\|")) for n in names))
        there = reduce(lambda a, b: a & b, (F.col("fields")[n].isNotNull() for n in names))
        parts.append(_where(there & (F.size(F.array_distinct(counts)) > 1), finding("parallel", F.concat(F.lit("counts "), F.array_join(counts.cast("array<string>"), ", ")), F.lit(group))))
    return F.concat(*parts)


def tax(total: str = "TOTAL_AMOUNT", gst: str = "GST_AMOUNT", inclusive: str = "IS_GST_INCLUDED") -> Column:
    """Included tax that isn't an eleventh of the total, rounded half up."""
    f = F.col("fields")
    t, g = f[total].try_cast("decimal(18,2)"), f[gst].try_cast("decimal(18,2)")
    return _where((F.lower(F.trim(f[inclusive])) == "true") & (g != gst_inclusive(t)), finding("gst", F.concat(F.lit("expected "), gst_inclusive(t).cast("string")), F.lit(gst)))


def balances(balance: str = "TRANSACTION_BALANCES", paid: str = "TRANSACTION_AMOUNTS_PAID", received: str = "TRANSACTION_AMOUNTS_RECEIVED", closing: str = "ACCOUNT_BALANCE") -> Column:
    """Broken links of the balance chain, and a closing balance that isn't the last one."""

    def numbers(name: str) -> Column:
        return F.transform(split_pipes(F.col("fields")[name]), lambda x: F.when(x == NOT_FOUND, F.lit(0)).otherwise(F.regexp_replace(x, ",", "").try_cast("decimal(18,2)")).cast("decimal(18,2)"))

    def but_first(name: str) -> Column:
        return F.slice(numbers(name), 2, 1 << 30)

    # each link beside the balance before it; shorter lists end in nulls, which break nothing
    links = F.arrays_zip(numbers(balance).alias("before"), but_first(balance).alias("now"), F.coalesce(but_first(paid), F.array().cast("array<decimal(18,2)>")).alias("paid"), F.coalesce(but_first(received), F.array().cast("array<decimal(18,2)>")).alias("received"))

    def broken(x: Column, i: Column) -> Column:
        expected = x["before"] - x["paid"] + x["received"]
        return F.when(x["now"] != expected, finding("balance", F.concat(F.lit("expected "), expected.cast("string")), F.lit(balance), i + 1))

    last = F.try_element_at(numbers(balance), F.lit(-1))
    return F.concat(_among(links, broken), _where(last != F.col("fields")[closing].try_cast("decimal(18,2)"), finding("closing", F.lit("isn't the last balance"), F.lit(closing))))


def rewards(opening: str, earned: str, bonus: str, redeemed: str, closing: str) -> Column:
    """Points that don't add up; commas are ignored."""

    def points(name: str) -> Column:
        return F.regexp_replace(F.col("fields")[name], ",", "").try_cast("bigint")

    expected = points(opening) + points(earned) + points(bonus) - points(redeemed)
    return _where(points(closing) != expected, finding("rewards", F.concat(F.lit("expected "), expected.cast("string")), F.lit(closing)))


def overflows(budgets: dict[str, Budget], advances: Advances) -> Column:
    """Fields whose text can't be laid out whole in its box: a backstop before anything is drawn."""
    tried = F.array(*(F.struct(F.lit(name).alias("name"), fit_text(F.col("fields")[name], budget, advances)["fault"].alias("fault")) for name, budget in budgets.items()))
    return _among(tried, lambda x, _: F.when(x["fault"].isNotNull(), finding("overflow", x["fault"], x["name"])))
