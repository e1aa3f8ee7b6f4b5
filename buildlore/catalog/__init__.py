"""Every registered query with its column types and, where SQL can say it, the same result in SQL."""

from importlib import import_module

AREAS = ["corpus", "extraction", "resolution", "graph", "ordering", "milestones", "retrieval", "ledger", "verification", "reports",
         "stateful"]


def load() -> None:
    for area in AREAS:
        import_module(f"buildlore.catalog.{area}")
