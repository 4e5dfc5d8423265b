"""All queries outside the language-model subpackage, by name."""

from __future__ import annotations

import importlib

from quern.plans.registry import ORACLES, QUERIES, Query

for _module in ("flagship", "scans", "dml", "projections", "joins", "subqueries", "aggregates", "windows", "sorting", "setops", "strings", "datetimes", "numbers", "collections", "documents", "misc", "setreturning", "userdefined", "streams"):
    importlib.import_module(f"quern.plans.{_module}")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
