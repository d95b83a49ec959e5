"""Named queries over the given tables, each with an SQL oracle where SQL can say it."""

from __future__ import annotations

import importlib

from echoloom.plans.registry import ORACLES, PLANS, Plan

MODULES = ["text", "scoring", "classify", "tickets", "analytics", "learning", "health", "dedup", "cluster", "sources", "streams", "stages"]


def all_plans() -> dict[str, Plan]:
    for name in MODULES:
        importlib.import_module(f"echoloom.plans.{name}")
    return dict(PLANS)
