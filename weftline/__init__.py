"""Spark-first select-project-join-SUM queries over integer relations, and corpus operators."""
