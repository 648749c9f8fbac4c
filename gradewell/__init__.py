"""Spark jobs for graded tests: scoring, rankings, access rules and table changes."""
