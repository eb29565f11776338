"""Named queries over the driver's tables; importing the modules registers them."""

from __future__ import annotations

from importlib import import_module

from noticelake.registry import QUERIES, SQL

MODULES = ["listing", "joining", "aggregating", "scalars", "storing", "deciding", "reconciling", "placing", "titling", "merging", "rebuilding", "fitting", "completing"]
for _name in MODULES:
    import_module(f"noticelake.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
