"""Checkpoint analytics as Spark jobs: every operator is a DataFrame-to-DataFrame function."""
