"""Policies, tiers and ground truth from YAML: every key is required, and an error says what, where, expected, recover."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml

from scrivana.functions.payments import CASH, NO_WALLET, Scheme, TerminalPools
from scrivana.functions.values import PosPools


class ConfigError(ValueError):
    def __init__(self, what: str, where: str, expected: str, recover: str):
        super().__init__(f"{what}\n  where: {where}\n  expected: {expected}\n  recover: {recover}")
        self.what, self.where, self.expected, self.recover = what, where, expected, recover


def read_yaml(path: str | Path) -> Any:
    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ConfigError("no such file", str(path), "a YAML file", "create it or correct the path") from None
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}", str(path), "a YAML mapping", "correct the syntax") from None


def mapping(value: Any, where: str, keys: set[str] | None = None, retired: set[str] = frozenset()) -> dict:
    """``value`` as a mapping with exactly ``keys``."""
    if not isinstance(value, dict):
        raise ConfigError(f"{type(value).__name__} instead of a mapping", where, "a mapping", "indent the keys below it")
    for found, what in ((retired & set(value), "retired"), (set(value) - keys if keys is not None else set(), "unknown"), (keys - set(value) if keys is not None else set(), "missing")):
        if found:
            raise ConfigError(f"{what} keys {sorted(found)}", where, f"exactly {sorted(keys or ())}", "add what is missing, delete what is not known")
    return value


def resolve_path(value: str, root: str | Path) -> Path:
    """``~`` and ``${VAR}`` expanded; relative to ``root``. An unset variable fails."""
    unset = [v for v in re.findall(r"\$\{(\w+)\}", value) if v not in os.environ]
    if unset:
        raise ConfigError(f"unset variables {unset}", value, "variables of the environment", f"export {unset[0]}")
    path = Path(re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], value)).expanduser()
    return path if path.is_absolute() else Path(root) / path


def ground_truth(path: str | Path) -> list[dict]:
    """Entries (case_id, layout, fields) of one document type, in file order; scalars become strings."""
    entries = mapping(read_yaml(path), str(path))
    rows = []
    for case, entry in entries.items():
        mapping(entry, f"{path}:{case}", {"layout", "fields"})
        fields = mapping(entry["fields"], f"{path}:{case}.fields")
        rows.append({"case_id": str(case), "layout": str(entry["layout"]), "fields": {str(k): _scalar(v) for k, v in fields.items()}})
    return rows


def _scalar(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def layouts(path: str | Path) -> dict[str, dict]:
    """Layouts by id below ``layouts:``; keys that begin with an underscore are anchors, any other sibling is a stray."""
    whole = mapping(read_yaml(path), str(path))
    strays = [k for k in whole if k != "layouts" and not str(k).startswith("_")]
    if strays or "layouts" not in whole:
        raise ConfigError(f"stray keys {strays}" if strays else "no layouts", str(path), "layouts: and _anchors", "move layouts below layouts:")
    return {str(k): mapping(v, f"{path}:layouts.{k}") for k, v in mapping(whole["layouts"], f"{path}:layouts").items()}


@dataclass(frozen=True)
class Tier:
    family: str
    name: str
    suffix: str
    mode: str
    settings: dict


def tiers(path: str | Path, families: list[str] | None = None) -> list[Tier]:
    """Tiers in file order; suffixes are unique; mode is skew or warp; optionally some families only."""
    found: list[Tier] = []
    for family, own in mapping(read_yaml(path), str(path)).items():
        for name, t in mapping(own, f"{path}:{family}").items():
            where = f"{path}:{family}.{name}"
            mapping(t, where)
            mode = (t.get("geometry") or {}).get("mode")
            if mode not in ("skew", "warp"):
                raise ConfigError(f"mode {mode!r}", where, "skew or warp", "set geometry.mode")
            if not isinstance(t.get("suffix"), str) or any(x.suffix == t["suffix"] for x in found):
                raise ConfigError(f"suffix {t.get('suffix')!r}", where, "a string no other tier has", "choose another suffix")
            found.append(Tier(str(family), str(name), t["suffix"], mode, t))
    unknown = sorted(set(families or ()) - {t.family for t in found})
    if unknown:
        raise ConfigError(f"unknown families {unknown}", str(path), f"some of {sorted({t.family for t in found})}", "correct the selection")
    return [t for t in found if families is None or t.family in families]


def scoring_policy(path: str | Path):
    from scrivana.functions.text import NormalisationPolicy
    from scrivana.operators.score import ScoringPolicy

    whole = mapping(read_yaml(path), str(path), {"normalisation", "reporting", "tables"})
    steps = mapping(whole["normalisation"], f"{path}:normalisation", set(NormalisationPolicy.__dataclass_fields__))
    if steps["unicode_form"] not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ConfigError(f"unicode_form {steps['unicode_form']!r}", str(path), "NFC, NFD, NFKC or NFKD", "choose one")
    wrong = [k for k, v in steps.items() if k != "unicode_form" and not isinstance(v, bool)]
    if wrong:
        raise ConfigError(f"{wrong} aren't true or false", f"{path}:normalisation", "booleans", "write true or false")
    reporting = mapping(whole["reporting"], f"{path}:reporting", {"degenerate_length_multiple", "percentiles"})
    tables = mapping(whole["tables"], f"{path}:tables", {"cell_comparison"})
    multiple = reporting["degenerate_length_multiple"]
    if isinstance(multiple, bool) or not isinstance(multiple, (int, float)):
        raise ConfigError(f"multiple {multiple!r}", f"{path}:reporting", "a number over 1", "write a number")
    try:
        return ScoringPolicy(NormalisationPolicy(**steps), float(multiple), tuple(reporting["percentiles"]), tables["cell_comparison"])
    except (ValueError, TypeError) as e:
        raise ConfigError(str(e), str(path), "see the message", "correct the value") from None


def pools(path: str | Path, root: str, required: dict[str, type]) -> dict:
    """Content pools below ``root``: each required key of its type, lists and mappings not empty."""
    whole = mapping(mapping(read_yaml(path), str(path)).get(root), f"{path}:{root}")
    for key, kind in required.items():
        value = whole.get(key)
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool or kind in (list, dict) and not value:
            raise ConfigError(f"{key} is {value!r}", f"{path}:{root}.{key}", f"a {kind.__name__}, not empty", "fill the pool")
    return whole


@dataclass(frozen=True)
class Selection:
    doc_types: tuple[str, ...]
    families: tuple[str, ...]


def selection(path: str | Path, doc_types: list[str], families: list[str]) -> Selection:
    """Document types and families to build, each one known and named once."""
    whole = mapping(read_yaml(path), str(path), {"doc_types", "families"})
    for key, known in (("doc_types", doc_types), ("families", families)):
        chosen = whole[key]
        if not isinstance(chosen, list) or not chosen or len(set(chosen)) < len(chosen) or set(chosen) - set(known):
            raise ConfigError(f"{key} {chosen!r}", f"{path}:{key}", f"a list of some of {sorted(known)}, each once", "correct the list")
    return Selection(tuple(whole["doc_types"]), tuple(whole["families"]))


# Keys of the run configuration, folders below its data root, and keys that are no longer read.
RUN_KEYS = ("dataset_root", "ground_truth_dir", "document_types")
RUN_FOLDERS = {"output_dir": "output", "derived_dir": "derived"}
RETIRED_RUN_KEYS = {"exports_dir": "an export is told its folder when it is run"}
TYPE_KEYS = ("ground_truth", "layouts", "output_subdir")


@dataclass(frozen=True)
class RunConfig:
    """Where a run reads and writes. Paths of data are absolute; those of tracked input stay as written."""

    dataset_root: Path
    output_dir: Path
    derived_dir: Path
    ground_truth_dir: str
    document_types: dict[str, dict[str, str]]


def run_config(path: str | Path) -> RunConfig:
    """The run configuration. Data paths may hold ``~`` and ``${VAR}``; relative ones start beside the file's folder."""
    whole = mapping(read_yaml(path), str(path))
    for key, why in RETIRED_RUN_KEYS.items():
        if key in whole:
            raise ConfigError(f"{key} is no longer read: {why}", f"{path}:{key}", "no such key", f"delete {key}")
    mapping({k: v for k, v in whole.items() if k not in RUN_FOLDERS}, str(path), set(RUN_KEYS))
    beside = Path(path).resolve().parent.parent
    root = resolve_path(str(whole["dataset_root"]), beside).resolve()
    folders = {key: resolve_path(str(whole[key]), beside).resolve() if key in whole else root / leaf for key, leaf in RUN_FOLDERS.items()}
    types = mapping(whole["document_types"], f"{path}:document_types")
    for name, own in types.items():
        mapping(own, f"{path}:document_types.{name}", set(TYPE_KEYS))
    return RunConfig(root, folders["output_dir"], folders["derived_dir"], str(whole["ground_truth_dir"]), types)


@dataclass(frozen=True)
class FieldDefinitions:
    """What fields documents may carry: by type, and more by layout; lists that run in parallel, and their item columns."""

    columns: tuple[str, ...]
    document_fields: dict[str, tuple[str, ...]]
    layout_fields: dict[str, tuple[str, ...]]
    parallel_groups: dict[str, tuple[tuple[str, ...], ...]]
    item_columns: dict[str, str]

    def of_type(self, doc_type: str) -> set[str]:
        """Fields of a document type, named in the singular or the plural."""
        named = {f"{name}s": fields for name, fields in self.document_fields.items()} | self.document_fields
        if doc_type not in named:
            raise ConfigError(f"no fields for {doc_type!r}", "document_fields", f"one of {sorted(self.document_fields)}", "add the type or correct its name")
        return set(named[doc_type])


@lru_cache(64)
def _field_definitions(path: str, changed: int) -> FieldDefinitions:
    whole = mapping(read_yaml(path), path)
    for key in ("all_columns", "document_fields", "parallel_field_groups", "line_item_column_names"):
        if key not in whole:
            raise ConfigError(f"{key} is missing", f"{path}:{key}", "a list of columns" if key == "all_columns" else "a mapping", f"add {key}")
    names = mapping(whole["line_item_column_names"], f"{path}:line_item_column_names")
    groups = {t: tuple(tuple(g) for g in own) for t, own in mapping(whole["parallel_field_groups"], f"{path}:parallel_field_groups").items()}
    unnamed = sorted({f for own in groups.values() for g in own for f in g} - set(names))
    if unnamed:
        raise ConfigError(f"no item column for {unnamed}", f"{path}:line_item_column_names", "one name for each field of a parallel group", "add them")
    lists = ({k: tuple(v) for k, v in mapping(whole.get(key) or {}, f"{path}:{key}").items()} for key in ("document_fields", "layout_fields"))
    return FieldDefinitions(tuple(whole["all_columns"]), *lists, groups, {str(k): str(v) for k, v in names.items()})


def field_definitions(path: str | Path) -> FieldDefinitions:
    """Read once for each state of the file."""
    if not Path(path).exists():
        raise ConfigError("no such file", str(path), "a YAML file", "create it or correct the path")
    return _field_definitions(str(path), Path(path).stat().st_mtime_ns)


@dataclass(frozen=True)
class SerialisationPolicy:
    """How events become text. Every key is stated in its file, also where it asks for nothing."""

    title_style: str
    pair_separator: str
    pair_strip_trailing_colon: bool
    table_style: str
    empty_cell_token: str
    cell_sub_line_join: str
    cell_newline_join: str
    split_order: str
    headerless_table: str
    carry_group_key: str
    block_separator: str
    emphasis: str
    decoration_glyphs: str
    decoration_min_run: int


# What each choice may be, and the least run that counts as decoration.
SERIALISATION_CHOICES = {
    "title_style": ("atx_h1",), "table_style": ("html",), "split_order": ("column_major",),
    "carry_group_key": ("down", "none"), "headerless_table": ("empty_header_row",), "emphasis": ("none",),
}
LEAST_DECORATION_RUN = 2


def serialisation_policy(path: str | Path) -> SerialisationPolicy:
    whole = mapping(read_yaml(path), str(path), set(SerialisationPolicy.__dataclass_fields__))
    for key, allowed in SERIALISATION_CHOICES.items():
        if whole[key] not in allowed:
            raise ConfigError(f"{key} is {whole[key]!r}", f"{path}:{key}", f"one of {list(allowed)}", "choose one of them")
    for key, kind in SerialisationPolicy.__annotations__.items():
        value, wanted = whole[key], {"str": str, "bool": bool, "int": int}[kind]
        if not isinstance(value, wanted) or wanted is int and isinstance(value, bool):
            raise ConfigError(f"{key} is {value!r}", f"{path}:{key}", f"a value of type {kind}", "correct the value")
    if not whole["decoration_glyphs"]:
        raise ConfigError("decoration_glyphs is empty", f"{path}:decoration_glyphs", "the characters of a run", "name some")
    if whole["decoration_min_run"] < LEAST_DECORATION_RUN:
        raise ConfigError(f"decoration_min_run is {whole['decoration_min_run']}", f"{path}:decoration_min_run", f"{LEAST_DECORATION_RUN} or more, as one glyph is no run", "raise it")
    return SerialisationPolicy(**whole)


def _whole(value: Any, where: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigError(f"{value!r}", where, f"a whole number, {least} or more", "correct the number")
    return value


# Keys of the pools of terminals and tills.
TERMINAL_KEYS = {"receipt_method_weights": dict, "acquirers": list, "schemes": dict, "wallets": dict, "entry_modes": dict, "wallet_presentation_weights": dict, "bank_description_methods": dict}
TERMINAL_NUMBERS = ("cash_tender_step", "cash_extra_notes")
SCHEME_KEYS = {"display", "aid", "pan_digits", "account_types"}
POS_NUMBERS = {"hour_min": 0, "hour_span": 1, "register_min": 0, "register_span": 1, "receipt_number_digest_length": 1}


def terminal_pools(path: str | Path, root: str = "payment_terminal") -> TerminalPools:
    """What payment slips are drawn from; schemes that methods and bank rows name must exist."""
    whole = pools(path, root, TERMINAL_KEYS)
    where = f"{path}:{root}"
    numbers = [_whole(whole.get(k), f"{where}.{k}", 1) for k in TERMINAL_NUMBERS]
    schemes = {}
    for name, own in whole["schemes"].items():
        own = mapping(own, f"{where}.schemes.{name}", SCHEME_KEYS)
        if not own["account_types"] or not own["display"] or not own["aid"]:
            raise ConfigError(f"scheme {name} has an empty value", f"{where}.schemes.{name}", "a display, an application id and account types", "fill them in")
        schemes[str(name)] = Scheme(str(own["display"]), str(own["aid"]), _whole(own["pan_digits"], f"{where}.schemes.{name}.pan_digits", 5), tuple(map(str, own["account_types"])))
    weights, shown = ({str(k): _whole(v, f"{where}.{key}.{k}", 0) for k, v in whole[key].items()} for key in ("receipt_method_weights", "wallet_presentation_weights"))
    wallets, prefixes = ({str(k): str(v) for k, v in whole[key].items()} for key in ("wallets", "bank_description_methods"))
    unknown = sorted(({m for m, w in weights.items() if w} - set(schemes) - set(wallets) - {CASH}) | (set(prefixes.values()) - set(schemes)) | ({m for m, w in shown.items() if w} - set(wallets) - {NO_WALLET}))
    if unknown:
        raise ConfigError(f"no scheme or wallet {unknown}", where, "names below schemes or wallets", "add them or correct the names")
    modes = mapping(whole["entry_modes"], f"{where}.entry_modes", {"card", "wallet"})
    return TerminalPools(weights, tuple(map(str, whole["acquirers"])), schemes, wallets, {k: str(v) for k, v in modes.items()}, shown, prefixes, *numbers)


def pos_pools(path: str | Path, root: str = "pos_terminal") -> PosPools:
    """What a till's printed details are drawn from."""
    whole = pools(path, root, {"staff_names": list, "receipt_number_prefix": str})
    where = f"{path}:{root}"
    if not all(isinstance(x, str) and x for x in whole["staff_names"]) or not whole["receipt_number_prefix"]:
        raise ConfigError("staff_names or receipt_number_prefix", where, "names, and a prefix that isn't empty", "fill them in")
    n = {k: _whole(whole.get(k), f"{where}.{k}", least) for k, least in POS_NUMBERS.items()}
    return PosPools(tuple(whole["staff_names"]), n["hour_min"], n["hour_span"], n["register_min"], n["register_span"], whole["receipt_number_prefix"], n["receipt_number_digest_length"])
