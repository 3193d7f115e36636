"""Sieveline: retrieval, weak supervision and evaluation as Spark DataFrame operations."""
