"""All queries of the library by name, gathered from the modules that hold them."""

from __future__ import annotations

from tributary.plans import changes, checks, dashboards, flows, graphs, history, impact, live, nested, order_summary, reports, stores, transforms, versions, workflows

MODULES = [order_summary, transforms, dashboards, checks, changes, graphs, flows, workflows, history, versions, live, nested, impact, stores, reports]
FLAGSHIP = "order_summary"


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
