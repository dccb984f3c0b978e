"""Evaluation-audit analytics as Spark DataFrame jobs."""
