"""Spark jobs that turn event logs and keyed change feeds into context tables."""
