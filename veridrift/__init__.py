"""Claim verification, uncertainty and drift analytics as Spark DataFrame operations."""
