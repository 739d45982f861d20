"""Structured Streaming versions of the feature and scoring jobs."""
