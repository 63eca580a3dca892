"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["windows", "screens", "stores", "health", "newsdesk", "intraday", "research", "validation", "settings", "landing", "streams"]

for _name in MODULES:
    importlib.import_module(f"tapeloom.plans.{_name}")

from tapeloom.plans.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
