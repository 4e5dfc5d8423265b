"""Recursive queries by generations, each cut to a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.files import cut as _cut


def union_distinct(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """WITH RECURSIVE ... UNION: each generation is what step() makes of the last one, less all rows seen.
    Ends when a generation is empty; more rounds than max_rounds are an error. Nulls count as equal."""
    new = _cut(base.distinct())
    seen = new
    parts = [new]
    for _ in range(max_rounds):
        if new.isEmpty():
            return seen
        made = step(new).select(*base.columns).distinct()
        new = _cut(made.join(seen.select(*[F.col(c).alias(f"_s_{c}") for c in base.columns]), [made[c].eqNullSafe(F.col(f"_s_{c}")) for c in base.columns], "left_anti"))
        parts.append(new)
        seen = seen.unionAll(new)
        if len(parts) % 16 == 0:
            seen = _cut(seen)
    raise RuntimeError("the recursion did not end")


def union_all(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """WITH RECURSIVE ... UNION ALL by generations."""
    new = _cut(base)
    seen = new
    for i in range(max_rounds):
        if new.isEmpty():
            return seen
        new = _cut(step(new).select(*base.columns))
        seen = seen.unionAll(new)
        if i % 16 == 15:
            seen = _cut(seen)
    raise RuntimeError("the recursion did not end")


def traverse(edges: DataFrame, roots: DataFrame, parent: str, child: str, order: Column | None = None) -> DataFrame:
    """Paths from roots (column child) over edges: child, depth, path, is_cycle. A path ends where it
    meets a node that it has (CYCLE); sorted by path it is SEARCH DEPTH FIRST, by depth BREADTH FIRST."""
    base = roots.select(F.col(child), F.lit(0).alias("depth"), F.array(child).alias("path"), F.lit(False).alias("is_cycle"))

    def step(last: DataFrame) -> DataFrame:
        e = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
        out = last.where("NOT is_cycle").join(e, F.col(child) == F.col("_p"))
        return out.select(F.col("_c").alias(child), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_c")).alias("path"), F.array_contains("path", F.col("_c")).alias("is_cycle"))

    return union_all(base, step)
