"""Load every catalogue module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = [
    "tabsieve.plans.catalog_profile",
    "tabsieve.plans.catalog_transform",
    "tabsieve.plans.catalog_analysis",
    "tabsieve.plans.catalog_models",
    "tabsieve.plans.catalog_closed_forms",
]


def load():
    for m in MODULES:
        importlib.import_module(m)
    from tabsieve.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
