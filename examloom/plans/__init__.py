"""Registered queries: each pairs a Spark plan with its SQL oracle."""

import importlib

FAMILIES = ["history", "schedule", "sampling", "marks", "merge", "sources", "text", "segment", "events"]


def load():
    """Import every family and return the registry."""
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import REGISTRY

    return REGISTRY
