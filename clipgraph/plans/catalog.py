"""Loads every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_scalar", "q_windows", "q_match", "q_aggregate", "q_metrics", "q_order", "q_graph", "q_sources", "q_extra"]


def load() -> None:
    for m in MODULES:
        import_module(f"clipgraph.plans.{m}")
