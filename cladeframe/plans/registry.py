"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules of this package that hold ``QUERIES`` and ``SQL``.
MODULES = ("scalars", "sketches", "trees", "profiles", "upkeep", "files")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        found = getattr(import_module(f"cladeframe.plans.{module}"), name)
        if out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(out.keys() & found.keys())}")
        out |= found
    return out


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
