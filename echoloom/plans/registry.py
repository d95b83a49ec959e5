"""Name → (Spark plan, optional oracle SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = re.sub(r"\n\s+", "\n", oracle).strip()
        return fn

    return register
