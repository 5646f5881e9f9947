"""Fact-graph analytics as plain PySpark DataFrame operators."""
