"""Feedback analytics as Spark jobs: table in, table out."""
