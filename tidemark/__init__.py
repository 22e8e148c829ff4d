"""Incident analytics as Spark DataFrame operators."""
