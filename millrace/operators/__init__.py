"""Relational operators: joins, aggregations, rules, graph steps and table changes."""
