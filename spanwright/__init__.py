"""Spark-first analytics over logged LLM traces."""
