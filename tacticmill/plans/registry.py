"""All queries of the plan modules."""

from __future__ import annotations

import importlib
import pkgutil

from tacticmill import plans
from tacticmill.plans.base import QUERIES, SQL

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.endswith("_plans"):
        importlib.import_module(f"tacticmill.plans.{_module.name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
