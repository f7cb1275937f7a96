"""Queries over the sample tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("qc", "prep", "timing", "currents", "store", "analysis")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in _FAMILIES:
        for name, value in getattr(import_module(f"tidelint.registry.{family}"), attribute).items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
