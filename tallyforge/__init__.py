"""Spark-first engine for evidence-bound record analytics."""
