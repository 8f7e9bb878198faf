"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["panels", "rankings", "contracts", "matching", "valuations", "quality", "maps", "collection"]


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
