"""Spatial-molecule analytics as Spark DataFrame operators."""
