"""Engagement analytics as Spark jobs: ingest, counts, features, labels, summaries, rules."""
