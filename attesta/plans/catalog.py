"""The engine's queries with their SQL oracles."""

from __future__ import annotations

from attesta.plans import assessments, claims, integrity, records, retrieval, text

FLAGSHIP = "keyword_topk_asof"
PLANS = (retrieval, text, integrity, records, claims, assessments)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
