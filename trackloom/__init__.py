"""Grouped, ordered sensor analytics as Spark jobs."""
