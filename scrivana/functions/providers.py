"""Row providers: what a table block draws, derived from an entry's fields as an array of structs.

Amounts stay decimals (null where the list says there is none), so that columns format them; ``synthetic`` tells rows that
stand for no item of their own, ``bold`` those that are drawn so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivana.functions.lists import counts_agree, is_present, let, present, split_pipes
from scrivana.functions.values import amount, bank_reference, format_amount

MONEY = "decimal(18,2)"
# The fields that a bank statement's rows come from.
BANK_FIELDS = {"date": "TRANSACTION_DATES", "description": "TRANSACTION_DESCRIPTIONS", "debit": "TRANSACTION_AMOUNTS_PAID", "credit": "TRANSACTION_AMOUNTS_RECEIVED", "balance": "TRANSACTION_BALANCES"}
BANK_ROW = f"struct<date:string,description:string,debit:{MONEY},credit:{MONEY},balance:{MONEY},reference:string,synthetic:boolean,bold:boolean>"


def bank_row(date: Column, description: Column, debit: Column, credit: Column, balance: Column, reference: Column, synthetic: bool, bold: bool) -> Column:
    return F.struct(date, description, debit, credit, balance, reference, F.lit(synthetic), F.lit(bold)).cast(BANK_ROW)


def listed(fields: Column, names: dict[str, str]) -> Column:
    """Rows of parallel pipe lists. Ragged ones fail; a list that is the sentinel alone is one absent item, and a group of
    nothing but such lists has no rows."""
    lists = {k: F.when(F.coalesce(fields[name], F.lit("")) != "", split_pipes(fields[name])).otherwise(F.array().cast("array<string>")) for k, name in names.items()}
    kind = f"array<struct<{','.join(f'`{k}`:string' for k in names)}>>"
    ragged = F.raise_error(F.lit(f"ragged rows: {', '.join(names.values())}")).cast(kind)
    nothing_there = ~F.exists(F.array(*(fields[name] for name in names.values())), is_present)
    return F.when(nothing_there, F.array().cast(kind)).when(counts_agree(*lists.values()), F.arrays_zip(*(v.alias(k) for k, v in lists.items()))).otherwise(ragged)


def bank_transactions(
    fields: Column, opening_balance: str | None = None, brought_forward: str | None = None, carried_forward: str | None = None,
    reference_prefix: str | None = None, reference_leader: str = "", balance_suffix: tuple[str, str] | None = None,
) -> Column:
    """A statement's rows with the balances that it states.

    ``opening_balance`` or ``brought_forward`` (the text of one of them) puts a row before the first, with the balance that
    stood then: the first row's, less what came in, plus what was paid. ``carried_forward`` puts a row after the last, with
    its balance. ``reference_prefix`` gives every stated row a reference of its description, ended by ``reference_leader``.
    ``balance_suffix`` (for debit, for credit) makes balances texts without a sign. A statement without rows has none at all.
    """
    if opening_balance is not None and brought_forward is not None:
        raise ValueError("opening_balance and brought_forward both name the first row; keep one of them")
    nothing = F.lit(None).cast("string")
    reference = (lambda r: F.concat(F.lit(reference_prefix), bank_reference(r["description"]), F.lit(reference_leader))) if reference_prefix is not None else (lambda r: nothing)
    money = lambda x: amount(present(x))
    absent = lambda x: F.when(is_present(x), money(x))
    stated = F.transform(listed(fields, BANK_FIELDS), lambda r: bank_row(r["date"], r["description"], absent(r["debit"]), absent(r["credit"]), money(r["balance"]), reference(r), False, False))

    def synthetic(label: str, balance: Column, bold: bool) -> Column:
        return F.array(bank_row(F.lit(""), F.lit(label), F.lit(None), F.lit(None), balance, nothing, True, bold))

    def whole(rows: Column) -> Column:
        first, last, parts = rows[0], F.try_element_at(rows, F.lit(-1)), [rows]
        leading = opening_balance if opening_balance is not None else brought_forward
        if leading is not None:
            before = first["balance"] - F.coalesce(first["credit"], F.lit(0)) + F.coalesce(first["debit"], F.lit(0))
            parts.insert(0, synthetic(leading, before, False))
        if carried_forward is not None:
            parts.append(synthetic(carried_forward, last["balance"], True))
        return F.when(F.size(rows) > 0, F.concat(*parts)).otherwise(rows) if len(parts) > 1 else rows

    rows = let(stated, whole)
    if balance_suffix is None:
        return rows
    debit, credit = balance_suffix
    ended = lambda b: F.concat(format_amount(F.abs(b)), F.when(b < 0, f" {debit}").otherwise(f" {credit}"))
    return F.transform(rows, lambda r: r.withField("balance", ended(r["balance"])))


def bank_transaction_totals(fields: Column, label: str) -> Column:
    """One bold row with the sums of what was paid and what came in."""
    rows = listed(fields, {k: BANK_FIELDS[k] for k in ("debit", "credit")})
    total = lambda key: lambda all_: F.aggregate(all_, F.lit(0).cast(MONEY), lambda a, r: (a + amount(r[key])).cast(MONEY))
    nothing = F.lit(None).cast("string")
    return let(rows, lambda all_: F.array(bank_row(F.lit(""), F.lit(label), total("debit")(all_), total("credit")(all_), F.lit(None), nothing, True, True)))


#: Providers by the name that a table block gives.
PROVIDERS = {"bank_transactions": bank_transactions, "bank_transaction_totals": bank_transaction_totals}
