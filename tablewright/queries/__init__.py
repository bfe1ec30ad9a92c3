"""All registered queries, one module per family."""

from importlib import import_module

MODULES = ("sources", "columns", "filters", "joins", "aggregates", "ordered", "cleaning", "quality", "profiles",
           "matching", "charts", "kpis", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tablewright.queries.{name}")
