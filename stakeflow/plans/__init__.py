"""Named queries: each pairs an operator call on the tables with its checking SQL."""

import importlib
import pkgutil

from stakeflow.plans.registry import QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES"]
