"""Loads every query module; the registry fills as a side effect."""

import importlib

from .registry import COVERS, ORACLE, QUERIES

MODULES = ("risk", "scoring", "reports", "billing", "linkage", "graph", "streaming", "lists", "insights", "extra", "overview")

for _m in MODULES:
    importlib.import_module(f"{__package__}.q_{_m}")

__all__ = ["COVERS", "ORACLE", "QUERIES"]
