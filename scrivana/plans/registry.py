"""Queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from scrivana.plans import corpora, formats, records, reports, settings


def _all() -> dict:
    return reports.QUERIES | corpora.QUERIES | records.QUERIES | formats.QUERIES | settings.QUERIES


def queries() -> dict:
    return {name: q.run for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _all().items() if q.sql}
