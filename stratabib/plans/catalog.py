"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from stratabib.plans import corpus_plans, institution_plans, mart_plans, preparation, resolve_plans, text_plans

FLAGSHIP = "topsis_scores"
_MODULES = [preparation, corpus_plans, resolve_plans, institution_plans, text_plans, mart_plans]


def queries():
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
