"""Query plans by family; importing a module registers its queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES, query

#: In the order of the operator inventory.
FAMILIES = ("sources", "filters", "joins", "aggregates", "windows", "ranking", "sets", "strings", "urls", "dates", "numbers", "collections", "retrieval", "corpus", "extraction", "incremental", "remaining", "formats", "stores", "states")

for _family in FAMILIES:
    import_module(f"{__name__}.{_family}")

__all__ = ["ORACLES", "QUERIES", "query"]
