"""Amounts, tax, checksums, dates and values derived from hashes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.lists import is_present, let
from scrivana.staging import spread

# Fixed values of the business-number checksum: weights of its eleven digits, and the modulus.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ABN_MODULUS = 89


def amount(value: Column, kind: str = "decimal(18,2)") -> Column:
    """A decimal; the sentinel and the empty string are 0, anything else malformed fails."""
    parsed = value.try_cast(kind)
    return F.when(~is_present(value), F.lit(0).cast(kind)).otherwise(F.coalesce(parsed, F.raise_error(F.concat(F.lit("not an amount: "), value)).cast(kind)))


def format_amount(value: Column) -> Column:
    """``$1,234.50``, rounded half up."""
    return F.concat(F.lit("$"), F.format_number(F.round(value, 2), 2))


def gst_inclusive(total: Column) -> Column:
    return F.round(total / F.lit(11).cast("decimal(4,0)"), 2).cast("decimal(18,2)")


def gst_exclusive(total: Column) -> Column:
    return F.round(total * F.lit("0.10").cast("decimal(3,2)"), 2).cast("decimal(18,2)")


def subtotal(total: Column, gst: Column) -> Column:
    return total - gst


def abn_is_valid(value: Column) -> Column:
    """Eleven digits; the first less one, weighted, sum to a multiple of 89."""
    def check(digits: Column) -> Column:
        weighted = (w * (F.substring(digits, i + 1, 1).cast("int") - (1 if i == 0 else 0)) for i, w in enumerate(ABN_WEIGHTS))
        return F.when(F.length(digits) == 11, reduce(add, weighted) % ABN_MODULUS == 0).otherwise(False)

    return let(F.regexp_replace(value, r"[^0-9]", ""), check)


def long_date(value: Column) -> Column:
    """``Sat 07 Oct 2023``; what isn't a date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(value, "dd/MM/yyyy"), "EEE dd MMM yyyy"), value)


def long_timestamp(date: Column, time: Column) -> Column:
    """``07 Oct 2023 at 02:05 PM``."""
    at = F.to_timestamp(F.concat_ws(" ", date, time), "dd/MM/yyyy HH:mm")
    return F.concat(F.date_format(at, "dd MMM yyyy"), F.lit(" at "), F.date_format(at, "hh:mm a"))


def hash_slice(digest: Column, start: int, end: int) -> Column:
    """Hex characters [start, end) of a digest as a number (15 characters at most)."""
    return F.conv(F.substring(digest, start + 1, end - start), 16, 10).cast("long")


def seed31(text: Column) -> Column:
    """31 bits from the first four bytes of a SHA-256."""
    return hash_slice(F.sha2(text, 256), 0, 8).bitwiseAND(F.lit(0x7FFFFFFF))


def page_seed(stem: Column, family: Column, name: Column) -> Column:
    return seed31(F.concat_ws("|", stem, family, name))


def bank_reference(description: Column) -> Column:
    """The 256-bit SHA-256 modulo 10**10, in ten digits: four hex digits at a time."""
    digest = F.sha2(description, 256)
    rest = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("decimal(38,0)"), lambda r, i: ((r * F.lit(65536).cast("decimal(6,0)") + F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("decimal(6,0)")) % F.lit(10**10).cast("decimal(11,0)")).cast("decimal(38,0)"))
    return F.lpad(rest.cast("string"), 10, "0")


def weighted_pool(weights: dict[str, int]) -> Column:
    """Names in sorted order, each as often as its weight."""
    return F.array(*(F.lit(name) for name in sorted(weights) for _ in range(weights[name])))


def pick(pool: Column, number: Column) -> Column:
    return F.element_at(pool, (number % F.size(pool)).cast("int") + 1)


def cash_tender(total: Column, extra: Column, step: int) -> tuple[Column, Column]:
    """Tendered and change: the next note strictly above the total, plus ``extra`` notes."""
    tendered = (F.floor(total / F.lit(step)) + 1 + extra) * F.lit(step)
    return tendered.cast("decimal(18,2)"), (tendered - total).cast("decimal(18,2)")


@dataclass(frozen=True)
class PosPools:
    """Ranges and names that a till's printed details are drawn from."""

    staff: tuple[str, ...]
    first_hour: int = 8
    hours: int = 12
    first_register: int = 1
    registers: int = 9
    number_prefix: str = "R"
    number_digits: int = 8


def receipt_pos(case_id: Column, date: Column, pools: PosPools) -> dict[str, Column]:
    """Time, register, staff and number printed on a receipt. Which hex characters of which digest settle what."""
    till = F.sha2(F.concat(case_id, F.lit(":pos:"), date), 256)
    number = F.sha2(F.concat(case_id, F.lit(":"), date), 256)
    hour = pools.first_hour + hash_slice(till, 0, 2) % pools.hours
    return {
        "POS_TIME": F.format_string("%02d:%02d", hour, hash_slice(till, 2, 4) % 60),
        "POS_REGISTER": F.format_string("%02d", pools.first_register + hash_slice(till, 4, 6) % pools.registers),
        "POS_STAFF": pick(F.array(*map(F.lit, pools.staff)), hash_slice(till, 6, 8)),
        "RECEIPT_NUMBER": F.concat(F.lit(pools.number_prefix), F.upper(F.substring(number, 1, pools.number_digits))),
    }


def make_abn(number: Column) -> Column:
    """A valid business number from the last nine digits of a number: the first two digits make the sum come out."""
    def whole(body: Column) -> Column:
        total = reduce(add, (w * F.substring(body, i + 1, 1).cast("int") for i, w in enumerate(ABN_WEIGHTS[2:])))
        digits = lambda lead: F.concat((F.floor(lead / 10) + 1).cast("string"), (lead % 10).cast("string"), body)
        spaced = lambda d: F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 3), F.substring(d, 9, 3))
        return let(let(F.pmod(-total, F.lit(ABN_MODULUS)), digits), spaced)

    return let(F.lpad((number % 10**9).cast("string"), 9, "0"), whole)


def seeded_choice(pool: Column, seed: Column) -> Column:
    """A pool's member that a seed settles."""
    return pick(pool, hash_slice(F.sha2(seed.cast("string"), 256), 0, 12))


#: Rounds of the permutation below, at any size of the pool.
SWAPS = 48


def cycle_place(position: Column, n: int | Column, seed: int) -> Column:
    """The place, of 0 to n - 1, of a position (from 0): every round of n positions takes each place once, in an order of
    its own.

    A keyed permutation by swap-or-not steps: each step pairs every place with another one by a key, and a bit that both
    of them share says whether they change places. So one place costs the same at any n, and no pool is put in order.
    """
    n = F.lit(n).cast("long")
    turn = F.floor(position / n).cast("string")

    def drawn(*parts: Column) -> Column:
        return hash_slice(F.sha2(F.concat_ws("|", F.lit(str(seed)), turn, *(x.cast("string") for x in parts)), 256), 0, 12)

    keys = F.transform(F.sequence(F.lit(0), F.lit(SWAPS - 1)), lambda r: F.struct(r.alias("r"), (drawn(r) % n).alias("k")))

    def step(at: Column, key: Column) -> Column:
        return let(F.pmod(key["k"] - at, n), lambda other: F.when(drawn(key["r"], F.greatest(at, other)) % 2 == 1, other).otherwise(at))

    return F.aggregate(keys, (position % n).cast("long"), step)


def cycled_choice(pool: list[str], position: Column, seed: int) -> Column:
    """No member again before all have been taken: the pool in an order of its own for each round of positions (from 0)."""
    return F.element_at(F.array(*map(F.lit, pool)), cycle_place(position, len(pool), seed).cast("int") + 1)


def cycled_from(rows: DataFrame, pool: DataFrame, position: str, place: str, seed: int) -> DataFrame:
    """The same with a pool of any size: a table whose ``place`` numbers its members from 0. Rows get their member's columns."""
    n = pool.count()
    if not n:
        raise ValueError("the pool is empty")
    # never null, or the join would compute every place once more to leave nulls out
    at = F.coalesce(cycle_place(F.col(position), n, seed), F.lit(-1).cast("long"))
    return spread(rows).withColumn(place, at).join(pool, place).drop(place)


def person(first_names: list[str], last_names: list[str], seed: Column) -> Column:
    """(first_name, last_name, full_name) that a seed settles."""
    digest = F.sha2(F.concat(F.lit("person|"), seed.cast("string")), 256)
    first, last = pick(F.array(*map(F.lit, first_names)), hash_slice(digest, 0, 12)), pick(F.array(*map(F.lit, last_names)), hash_slice(digest, 12, 24))
    return F.struct(first.alias("first_name"), last.alias("last_name"), F.concat_ws(" ", first, last).alias("full_name"))


def address(streets: list[str], towns: list[str], seed: Column, highest: int = 200) -> Column:
    """``12 High St, Town`` that a seed settles; a town carries its state and postcode."""
    digest = F.sha2(F.concat(F.lit("address|"), seed.cast("string")), 256)
    number = hash_slice(digest, 0, 8) % highest + 1
    street, town = pick(F.array(*map(F.lit, streets)), hash_slice(digest, 8, 20)), pick(F.array(*map(F.lit, towns)), hash_slice(digest, 20, 32))
    return F.concat(number.cast("string"), F.lit(" "), street, F.lit(", "), town)


def counted_description(description: Column, quantity: Column, prefix: str = "{quantity}x ") -> Column:
    """A receipt line's text, with its quantity in front unless there is one of it or none is stated."""
    stated = F.replace(F.lit(prefix), F.lit("{quantity}"), quantity)
    return F.when(is_present(quantity) & (quantity != "1"), F.concat(stated, description)).otherwise(description)


def currency(value: Column, style: str = "symbol", suffix: str | None = None) -> Column:
    """An amount with its symbol, or plain, and an optional suffix."""
    if style not in ("symbol", "plain"):
        raise ValueError(f"currency style {style!r}; expected symbol or plain")
    text = format_amount(value) if style == "symbol" else F.replace(format_amount(value), F.lit("$"), F.lit(""))
    return F.concat(text, F.lit(f" {suffix}")) if suffix else text


def signed_balance(value: Column, credit: str = "CR", debit: str = "DR") -> Column:
    """A balance without its sign, the side it is on after it."""
    return F.concat(format_amount(F.abs(value)), F.when(value >= 0, f" {credit}").otherwise(f" {debit}"))
