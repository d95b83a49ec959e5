"""Jobs put together from stages: each a table-to-table function, taken only where its condition holds.

A condition is an aggregate over the stage's whole input (say, `F.count("*") > 0`), so deciding costs one
row at the driver. Rows that do not fit a stage's `valid` predicate pass by it unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """`job` gets the rows that are `valid` (all, if None); `finish` gets its result.

    Without `keep_invalid` the other rows are dropped; with it the job must return the columns it got.
    A stage that is not `enabled`, or whose condition is not true, hands its rows on. `after` names
    stages that must have been taken.
    """

    name: str
    job: Callable[[DataFrame], DataFrame]
    condition: Column | None = None
    valid: Column | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None
    keep_invalid: bool = False
    enabled: bool = True
    after: tuple[str, ...] = ()


def run_stages(rows: DataFrame, stages: list[Stage]) -> tuple[DataFrame, dict[str, str]]:
    """(result, {stage: taken, disabled or skipped}); the plan holds the taken stages only.

    A stage that asks for one that was not taken is an error.
    """
    said: dict[str, str] = {}
    for stage in stages:
        if stage.name in said:
            raise ValueError(f"two stages are named {stage.name}")
        if not stage.enabled:
            said[stage.name] = "disabled"
            continue
        missing = [name for name in stage.after if said.get(name) != "taken"]
        if missing:
            raise ValueError(f"stage {stage.name} needs {', '.join(missing)}")
        fits = F.coalesce(stage.valid, F.lit(False)) if stage.valid is not None else None
        mine = rows.where(fits) if fits is not None else rows
        if stage.condition is not None and not mine.agg(stage.condition.alias("holds")).first()[0]:
            said[stage.name] = "skipped"
            continue
        out = mine.transform(stage.job)
        if stage.finish is not None:
            out = out.transform(stage.finish)
        if fits is not None and stage.keep_invalid:
            out = out.unionByName(rows.where(~fits))
        rows, said[stage.name] = out, "taken"
    return rows, said
