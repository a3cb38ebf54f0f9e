"""Spark-first analytics over semi-structured schedules, logbooks and text corpora."""
