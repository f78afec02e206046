"""Importing this module registers every query."""

from millrace.plans import q_graph, q_items, q_more, q_plans, q_reports, q_sources, q_text  # noqa: F401
