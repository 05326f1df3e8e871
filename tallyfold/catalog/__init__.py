"""The registered queries, one per operator of the inventory."""

from __future__ import annotations

import importlib

MODULES = ("ev_core", "ev_model", "ev_report", "li", "pg", "doc", "cv", "logs", "folders", "rates", "feed", "stored", "results", "live")


def load():
    """Import every query module once and return the registry."""
    for module in MODULES:
        importlib.import_module(f"tallyfold.catalog.{module}")
    return importlib.import_module("tallyfold.catalog.registry")
