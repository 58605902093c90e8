"""Compositions of operators, and the registered queries."""

from importlib import import_module

_MODULES = ("frame_queries", "catalog_queries", "file_queries", "picture_queries", "model_queries", "sink_queries", "stream_queries", "curation")


def registered():
    """The registry, with all query modules loaded."""
    for name in _MODULES:
        import_module(f"imgcurate.plans.{name}")
    return import_module("imgcurate.plans.registry")
