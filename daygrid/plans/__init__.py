"""Named queries over the sample tables, each next to its check in plain SQL."""

from importlib import import_module

FAMILIES = ("scans", "panels", "regression", "inference", "systems", "checks")


def load() -> None:
    """Import every query family once, which registers its queries."""
    for name in FAMILIES:
        import_module(f"daygrid.plans.{name}")
