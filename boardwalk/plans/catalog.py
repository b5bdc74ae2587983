"""All queries over the warehouse tables, and their SQL."""

from __future__ import annotations

from boardwalk.plans import folds, oracle, products, streams
from boardwalk.plans.queries import REGISTRY

SQL = {**oracle.SQL, **folds.SQL, **products.SQL, **streams.SQL}

__all__ = ["REGISTRY", "SQL"]
