"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("grid", "metrics", "growth", "raster", "timeline", "records", "geometry", "values", "files", "streams")
FLAGSHIP = "slice_project_growth"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"landfold.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"landfold.plans.{m}").ORACLE_SQL.items()}
