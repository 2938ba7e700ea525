"""All queries of the keyword engine and their SQL."""

from __future__ import annotations

from seedsift.plans import agreement_queries, anchor_queries, decision_queries, domain_queries, expand_queries, fold_queries, form_queries, geo_queries, grammar_queries, keyword_queries, place_queries, rule_queries, seed_queries, word_queries

MODULES = (keyword_queries, fold_queries, expand_queries, decision_queries, geo_queries, grammar_queries, anchor_queries, domain_queries, agreement_queries, place_queries, seed_queries, word_queries, form_queries, rule_queries)


def queries():
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}
