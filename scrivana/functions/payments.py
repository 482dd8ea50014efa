"""Terminal slips: how a receipt was paid, all of it from slices of one digest of the case and its date."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivana.functions.values import cash_tender, hash_slice, long_timestamp, pick, weighted_pool

# Which hex characters of the digest settle what. The first eight belong to the till (values.receipt_pos).
SLICES = {"method": (10, 14), "acquirer": (14, 16), "scheme": (16, 18), "last4": (18, 22), "psn": (22, 24), "atc": (24, 28), "terminal": (28, 32), "reference": (32, 38), "notes": (38, 40)}
CASH, NO_WALLET = "Cash", "none"


@dataclass(frozen=True)
class Scheme:
    display: str
    aid: str
    pan_digits: int
    account_types: tuple[str, ...]


@dataclass(frozen=True)
class TerminalPools:
    """What slips are drawn from."""

    method_weights: dict[str, int]
    acquirers: tuple[str, ...]
    schemes: dict[str, Scheme]
    wallets: dict[str, str] = field(default_factory=dict)
    entry_modes: dict[str, str] = field(default_factory=lambda: {"card": "(c)", "wallet": "(t)"})
    presentation_weights: dict[str, int] = field(default_factory=lambda: {NO_WALLET: 1})
    bank_prefixes: dict[str, str] = field(default_factory=dict)
    tender_step: int = 5
    extra_notes: int = 3


def scheme_of_description(description: Column, prefixes: dict[str, str]) -> Column:
    """The scheme of the longest prefix that a bank row's description begins with; without one it fails."""
    found = F.raise_error(F.concat(F.lit("no scheme for bank row "), description)).cast("string")
    for prefix in sorted(prefixes, key=len):
        found = F.when(F.startswith(description, F.lit(prefix)), F.lit(prefixes[prefix])).otherwise(found)
    return found


def slip(case_id: Column, date: Column, total: Column, time: Column, pools: TerminalPools, bank_description: Column | None = None) -> Column:
    """A struct of what a terminal prints; what a kind of payment doesn't print is empty, amounts of cash null.

    A linked bank row fixes the scheme; the slice that would have drawn a method then draws whether a wallet presents it.
    Without one (null too), the method is drawn, and a wallet's scheme by a slice of its own.
    """
    digest = F.sha2(F.concat(case_id, F.lit(":pos:"), date), 256)
    part = {name: hash_slice(digest, *ends) for name, ends in SLICES.items()}
    linked = F.lit(False) if bank_description is None else bank_description.isNotNull()
    drawn = pick(weighted_pool(pools.method_weights), part["method"])
    forced = F.lit(None).cast("string") if bank_description is None else F.when(linked, scheme_of_description(bank_description, pools.bank_prefixes))
    shown = pick(weighted_pool(pools.presentation_weights), part["method"])
    method = F.when(~linked, drawn).when(shown == NO_WALLET, forced).otherwise(shown)
    by_cash, by_wallet = method == CASH, method.isin(*pools.wallets) if pools.wallets else F.lit(False)
    any_scheme = pick(F.array(*map(F.lit, sorted(pools.schemes))), part["scheme"])
    scheme = F.coalesce(forced, F.when(by_wallet, any_scheme).otherwise(method))

    def of_scheme(value) -> Column:
        known = F.create_map(*(x for name, s in pools.schemes.items() for x in (F.lit(name), value(s))))
        return F.coalesce(known[scheme], F.raise_error(F.concat(F.lit("unknown scheme "), scheme)))

    def unless_cash(value: Column) -> Column:
        return F.when(by_cash, F.lit("")).otherwise(value)

    account_types = of_scheme(lambda s: F.array(*map(F.lit, s.account_types)))
    tendered, change = cash_tender(total, part["notes"] % pools.extra_notes, pools.tender_step)
    mode = F.when(by_wallet, pools.entry_modes["wallet"]).otherwise(pools.entry_modes["card"])
    names = F.create_map(*(F.lit(x) for pair in (pools.wallets or {"": ""}).items() for x in pair))
    values = {
        "method": method,
        "kind": F.when(by_cash, "cash").when(by_wallet, "wallet").otherwise("card"),
        "scheme": unless_cash(scheme),
        "scheme_display": unless_cash(of_scheme(lambda s: F.lit(s.display))),
        "account_type": unless_cash(pick(account_types, part["scheme"])),
        "acquirer": pick(F.array(*map(F.lit, pools.acquirers)), part["acquirer"]),
        "aid": unless_cash(of_scheme(lambda s: F.lit(s.aid))),
        "masked_pan": unless_cash(F.concat(F.repeat(F.lit("x"), of_scheme(lambda s: F.lit(s.pan_digits)) - 4), F.format_string("%04d", part["last4"] % 10000))),
        "entry_mode": unless_cash(mode),
        "psn": unless_cash(F.format_string("%02d", part["psn"] % 100)),
        "atc": unless_cash(F.upper(F.substring(digest, SLICES["atc"][0] + 1, 4))),
        "terminal_id": unless_cash((part["terminal"] % 99 + 1).cast("string")),
        "transaction_ref": unless_cash(F.format_string("%06d", part["reference"] % 1000000)),
        "timestamp": long_timestamp(date, time),
        "wallet_label": F.when(by_wallet, names[method]).otherwise(""),
        "tendered": F.when(by_cash, tendered),
        "change": F.when(by_cash, change),
    }
    return F.struct(*(c.alias(name) for name, c in values.items()))
