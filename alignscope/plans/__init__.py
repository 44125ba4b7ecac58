"""Whole runs: configuration, profiling, matching, reporting."""
