"""All registered queries, by family."""

from __future__ import annotations

from lodestone.plans import courses, relational, retrieval, streams, texts
from lodestone.plans.registry import Query

FAMILIES = (relational, texts, retrieval, courses, streams)


def queries() -> dict[str, Query]:
    return {k: f for family in FAMILIES for k, f in family.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for family in FAMILIES for k, s in family.registry.sql.items()}
