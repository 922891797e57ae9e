"""Registered queries over the driver tables."""

from importlib import import_module

_MODULES = ("verdict_queries", "text_queries", "record_queries", "sample_queries", "run_queries")


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        import_module(f"verdictframe.plans.{name}")
    return import_module("verdictframe.plans.registry")
