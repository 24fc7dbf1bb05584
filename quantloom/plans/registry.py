"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "x20_rolling_backtest"
MODULES = ("market", "trading", "research", "live", "rules", "feeds", "contracts", "fitting", "writing", "auditing")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
