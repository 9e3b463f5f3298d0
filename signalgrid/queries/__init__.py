"""Registered queries by subject."""

from __future__ import annotations

import importlib

MODULES = ("dense", "scores", "paired", "splits", "audits", "intake", "learning")


def load_all():
    """All registered queries, in registration order."""
    from signalgrid.queries.registry import REGISTRY

    for module in MODULES:
        importlib.import_module(f"signalgrid.queries.{module}")
    return REGISTRY
