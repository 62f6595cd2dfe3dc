"""Modules that register queries."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("search", "joins", "aggregates", "scalars", "vectors", "rules", "tables_in_text", "matching", "spans", "classifiers", "evidence", "graph", "pipelines")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"papyrine.plans.{name}")
