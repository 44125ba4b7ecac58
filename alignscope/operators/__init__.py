"""Operators over knowledge-graph pairs: metrics, graph, matching, evaluation, reports."""
