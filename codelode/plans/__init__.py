"""Query plans over the test tables, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ["usage", "text", "versions", "analysis", "rewrites", "streams", "ingest"]


def load_all():
    """Import every area and return ``(plans, oracles)`` by query name."""
    for area in AREAS:
        importlib.import_module(f"codelode.plans.{area}")
    from codelode.plans.registry import ORACLES, PLANS

    return dict(PLANS), dict(ORACLES)
