"""Checked queries: each operator on the driver's tables, with SQL for comparison."""

from __future__ import annotations

from importlib import import_module

from leafclock.registry.base import ORACLE, QUERIES

for _part in ("cleaning", "joins", "flags", "summaries", "grids", "reports"):
    import_module(f"leafclock.registry.{_part}")

__all__ = ["ORACLE", "QUERIES"]
