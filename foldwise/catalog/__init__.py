"""All registered queries."""

from importlib import import_module

MODULES = ("resampling", "metrics", "ingest", "compare", "checks", "preprocessing", "fits")


def load():
    from foldwise.catalog.registry import ENTRIES

    for name in MODULES:
        import_module(f"foldwise.catalog.{name}")
    return ENTRIES
