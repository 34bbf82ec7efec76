"""Spark jobs that turn recognised lines of scanned share certificates into validated tables."""
