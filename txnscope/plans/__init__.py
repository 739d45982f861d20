"""Registered queries (Spark) and their SQL twins."""
