"""Spark jobs for agent memory, work graphs and training-data preparation."""
