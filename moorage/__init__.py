"""Ranking candidate providers from their deployment history, on Spark."""
