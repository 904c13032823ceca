"""Registered queries, one module for each family of operators."""

from __future__ import annotations

import importlib

FAMILIES = ("pages", "graphs", "catalogs", "stored", "web", "texts", "logs", "substrate")


def load() -> None:
    """Import every family, which registers its queries."""
    for name in FAMILIES:
        importlib.import_module(f"loomstone.plans.{name}")
